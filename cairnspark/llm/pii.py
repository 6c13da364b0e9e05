"""Personal data: plain patterns, and a semi-Markov conditional random field that scores whole spans."""

from __future__ import annotations

import bisect
import itertools
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"

LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the plain patterns, leftmost and non-overlapping within each kind, in linear time.

    A mail address is looked for around each ``@``: its local part can hold no ``@``, so it is the whole run of
    local characters before it that no earlier match has taken.
    """
    out = []
    end = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", begin, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if re.search("[0-9]", text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if octets(m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# The random field.  Labels: one of KINDS for a segment of up to MOST_TOKENS tokens, or "other" for one token.

MOST_TOKENS, MOST_CHARS = 20, 48
MARGIN = MOST_CHARS  # a candidate holds its anchor, so it reaches no further from it
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
ANCHOR = re.compile(r"[0-9@]|[(\[{] ?(?:at|AT) ?[)\]}]")
AT = re.compile(r"@| ?[(\[{] ?(?:at|AT) ?[)\]}] ?")
DOT = re.compile(r" ?[(\[{] ?(?:dot|DOT|\.) ?[)\]}] ?")
NUMERIC = re.compile(r"[0-9+(][0-9 +().\-\[\]/]*[0-9]")
MAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+")
FEATURES = ("bias", "bounded", "plain-dots", "one-at", "mail-shape", "known-tld", "four-groups", "octets", "only-dots", "digits-16-19", "luhn", "equal-groups", "plus", "parenthesis", "digits-10-13", "last-four", "telephone-groups", "digits-7-9", "glued", "zero-lead", "date-like", "mixed-separators", "telephone-word", "card-word", "address-word")
WORDS = {"telephone-word": r"(?i)(?:tel|phone|call|fax|mobile|cell)\W*$", "card-word": r"(?i)(?:card|visa|credit|payment)\W*$", "address-word": r"(?i)(?:ip|host|server|address)\W*$"}
BEFORE = {k: re.compile(v) for k, v in WORDS.items()}


def span_features(text: str, start: int, end: int) -> list[list[int]] | None:
    """Features of a whole span by kind, or None where no kind can fit it."""
    span = text[start:end]
    left, right = text[start - 1 : start], text[end : end + 1]
    glued = bool(re.match(r"[\w@]", left) or re.match(r"[\w@]", right) or (right in tuple("-.,/") and text[end + 1 : end + 2].isdigit()) or (left in tuple("-.,/$€#") and (left in tuple("$€#") or text[start - 2 : start - 1].isdigit())))
    has = {"bias"} | ({"glued"} if glued else {"bounded"})
    mail = DOT.sub(".", AT.sub("@", span))
    if mail.count("@") == 1 and (mail[0].isalnum() and mail[-1].isalnum()):
        has.add("one-at")
        if MAIL.fullmatch(mail):
            has.add("mail-shape")
        if re.search(r"\.[A-Za-z]{2,6}$", mail):
            has.add("known-tld")
        kinds = ("email",)
    else:
        plain = DOT.sub(".", span)
        if not NUMERIC.fullmatch(plain) or not 4 <= sum(c.isdigit() for c in plain) <= 19:
            return None
        groups, digits = re.findall("[0-9]+", plain), re.sub("[^0-9]", "", plain)
        marks = set(re.sub("[0-9]", "", plain))
        n = len(digits)
        tests = {
            "four-groups": len(groups) == 4, "octets": len(groups) == 4 and octets(groups), "only-dots": marks == {"."}, "digits-16-19": n >= 16, "luhn": n >= 13 and luhn(digits),
            "equal-groups": len(groups) > 2 and len({len(g) for g in groups[:-1]}) == 1 and len(groups[0]) == 4, "plus": plain[0] == "+", "parenthesis": bool(re.match(r"\+?[0-9]* ?\([0-9]{2,4}\)", plain)), "digits-10-13": 10 <= n <= 13,
            "last-four": len(groups[-1]) == 4, "telephone-groups": 3 <= len(groups) <= 5 and all(2 <= len(g) <= 4 for g in groups[-3:]) and len(groups[-2]) == 3, "digits-7-9": 7 <= n <= 9, "zero-lead": any(len(g) > 1 and g[0] == "0" for g in groups),
            "date-like": bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2}", plain)), "mixed-separators": len(marks - {" ", "(", ")", "+"}) > 1,
        }
        has |= {k for k, v in tests.items() if v}
        kinds = ("ip", "card", "phone")
    before = text[max(0, start - 16) : start]
    has |= {k for k, r in BEFORE.items() if r.search(before)}
    on = [FEATURES.index(f) for f in has]
    return [on if kind in kinds else [] for kind in KINDS]


def in_token(text: str, k: int) -> bool:
    """Whether a cut before character k parts a token of letters or digits."""
    pair = text[k - 1 : k + 1]
    return 0 < k < len(text) and pair.isascii() and (pair.isalpha() or pair.isdigit())


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches that can hold an entity: all others have one labelling, so the field splits there exactly.

    They begin and end at token edges.
    """
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        least = out[-1][1] if out else 0
        s, e = max(0, m.start() - MARGIN), max(least, min(m.end() + MARGIN, len(text)))
        while s > least and in_token(text, s):
            s -= 1
        while in_token(text, e):
            e += 1
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def segments(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], dict[tuple[int, int], list[list[int]]]]:
    """Tokens of an island, and the candidate segments (first token, last token) with their features."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]
    found = {}
    for i, (s, _) in enumerate(tokens):
        if not (text[s].isalnum() or text[s] in "+("):
            continue
        seen = False
        for j in range(i, min(i + MOST_TOKENS, len(tokens))):
            e = tokens[j][1]
            if e - s > MOST_CHARS or (j > i and tokens[j][0] - tokens[j - 1][1] > 1):
                break
            seen = seen or text[tokens[j][0]].isdigit() or text[tokens[j][0]] == "@" or text[tokens[j][0] : e].lower() == "at"
            if seen and text[e - 1].isalnum() and (f := span_features(text, s, e)):
                found[i, j] = f
    return tokens, found


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top if len(values) == 1 else top + math.log(sum(math.exp(v - top) for v in values))


class Field:
    """Weights by kind and feature; a token outside entities scores 0."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def scores(self, found) -> dict[tuple[int, int], list[float]]:
        return {ij: [float(self.weights[k, on].sum()) if on else -np.inf for k, on in enumerate(by_kind)] for ij, by_kind in found.items()}

    def best(self, n: int, scores) -> list[tuple[int, int, int]]:
        """Viterbi over segment ends: the joint choice of boundaries and kinds of highest total score."""
        ends: dict[int, list] = {}
        for (i, j), by_kind in scores.items():
            k = int(np.argmax(by_kind))
            ends.setdefault(j + 1, []).append((by_kind[k], i, k))
        total, back = [0.0] * (n + 1), [None] * (n + 1)
        for t in range(1, n + 1):
            total[t] = total[t - 1]
            for score, i, k in ends.get(t, ()):
                if total[i] + score > total[t]:
                    total[t], back[t] = total[i] + score, (i, t - 1, k)
        out, t = [], n
        while t:
            if back[t] is None:
                t -= 1
            else:
                out.append(back[t])
                t = back[t][0]
        return out[::-1]

    def expected(self, n: int, scores) -> tuple[float, dict[tuple[int, int, int], float]]:
        """Log partition and the marginal of each labelled segment, by the forward and backward sums."""
        arcs = [(i, j, k, s) for (i, j), by_kind in scores.items() for k, s in enumerate(by_kind) if s > -np.inf]
        into: dict[int, list] = {}
        outof: dict[int, list] = {}
        for i, j, _, s in arcs:
            into.setdefault(j + 1, []).append((i, s))
            outof.setdefault(i, []).append((j + 1, s))
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for t in range(1, n + 1):
            forward[t] = log_sum([forward[t - 1], *(forward[i] + s for i, s in into.get(t, ()))])
        for t in range(n - 1, -1, -1):
            backward[t] = log_sum([backward[t + 1], *(backward[j] + s for j, s in outof.get(t, ()))])
        return forward[n], {(i, j, k): math.exp(forward[i] + s + backward[j + 1] - forward[n]) for i, j, k, s in arcs}


def examples(count: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with labelled spans: entities in several spellings, and numbers that are none."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))

    def card(valid: bool) -> str:
        head = digits(15)
        last = next(d for d in "0123456789" if luhn(head + d))
        number = head + (last if valid else str((int(last) + rng.randint(1, 9)) % 10))
        return rng.choice(["", " ", "-", "."]).join([number[k : k + 4] for k in range(0, 16, 4)])

    def entity(kind: int) -> str:
        if kind == 0:
            at, dot = rng.choice([("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "(dot)"), ("@", " (dot) ")])
            return f"{word()}{rng.choice(['', '.' + word(), digits(2)])}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"
        if kind == 1:
            return rng.choice([".", ".", "[.]", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            return card(True)
        return rng.choice(["({}) {}-{}", "{}-{}-{}", "+1 ({}) {}-{}", "{}.{}.{}", "+1 {} {} {}", "+44 {} {} {}"]).format(str(rng.randint(201, 989)), digits(3), digits(4))

    def other() -> str:
        return rng.choice([
            lambda: card(False), lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1990, 2030)}", lambda: f"${rng.randint(1, 99)},{digits(3)}.{digits(2)}",
            lambda: digits(rng.randint(1, 14)), lambda: f"{rng.randint(1, 12)}:{rng.randint(10, 59)}", lambda: f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(256, 900)}.{rng.randint(0, 99)}", lambda: f"@{word()}", lambda: f"{word()} (at) {word()}", lambda: f"{digits(4)}-{digits(4)}-{digits(2)}", lambda: f"{digits(3)} {digits(3)}", lambda: f"{digits(5)}-{digits(4)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}",
        ])()

    out = []
    for _ in range(count):
        parts, gold, size = [], [], 0
        for _ in range(rng.randint(3, 7)):
            draw = rng.random()
            kind = rng.randrange(4) if draw < 0.3 else None
            piece = entity(kind) if kind is not None else other() if draw < 0.55 else word()
            if kind is not None:
                gold.append((size, size + len(piece), kind))
            parts.append(piece)
            size += len(piece) + 1
            parts.append(word())
            size += len(parts[-1]) + 1
        out.append((" ".join(parts) + ".", gold))
    return out


@lru_cache(1)
def trained(sentences: int = 160, rounds: int = 40, rate: float = 0.4, decay: float = 2e-3) -> Field:
    """Weights that maximise the conditional likelihood of the generated sentences (Adagrad, deterministic)."""
    data = []
    for text, gold in examples(sentences):
        tokens, found = segments(text, 0, len(text))
        of = {span: ij for ij in found for span in [(tokens[ij[0]][0], tokens[ij[1]][1])]}
        data.append((len(tokens), found, [(*of[s, e], k) for s, e, k in gold if (s, e) in of]))
    field = Field(np.zeros((len(KINDS), len(FEATURES))))
    squares = np.full_like(field.weights, 1e-6)
    for _ in range(rounds):
        gradient = -decay * len(data) * field.weights
        for n, found, gold in data:
            for i, j, k in gold:
                gradient[k, found[i, j][k]] += 1
            for (i, j, k), p in field.expected(n, field.scores(found))[1].items():
                gradient[k, found[i, j][k]] -= p
        squares += gradient**2
        field.weights = field.weights + rate * gradient / np.sqrt(squares)
    return field


def added_spans(text: str, field: Field, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Entities of the field's best labelling that overlap no base span."""
    out = []
    busy = sorted((s, e) for _, s, e in taken)
    begins, ends = [s for s, _ in busy], list(itertools.accumulate((e for _, e in busy), max))
    for start, end in islands(text):
        tokens, found = segments(text, start, end)
        for i, j, k in field.best(len(tokens), field.scores(found)) if found else ():
            s, e = tokens[i][0], tokens[j][1]
            before = bisect.bisect_left(begins, e)  # base spans that begin before this one ends
            if not before or ends[before - 1] <= s:
                out.append((KINDS[k], s, e))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, base) for every row of ``docs``, in code points, end exclusive.

    Spans are ordered by kind as listed in KINDS, then start.  Besides the plain patterns, whose matches have no
    bound, the field adds entities of at most MOST_TOKENS tokens and MOST_CHARS characters that overlap no plain
    match; of labellings of equal score it takes the one with fewer and then the later entities.  Null and empty texts have none; null ids and repeated
    rows give a row each; an empty table gives none.  Texts are read whole.  Other columns are ignored.
    """
    field = Field(trained().weights)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(text, field, base)]
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                rows.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return per_batch(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, spans {SPANS}", make)


def span_report(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, and spans of all, as ``kind:start:end`` joined by commas."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(F.filter("spans", lambda s: s["base"])["kind"], lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in kinds]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
