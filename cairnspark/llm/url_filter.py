"""URL filter: a bit-parallel automaton that runs every glob rule at once over each canonical URL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, per_batch


@dataclass(frozen=True)
class Rule:
    """``name`` as host/path.  A site rule fits its host, all subdomains, and paths that start with its path."""

    verdict: str
    name: str
    globs: tuple[str, ...]
    site: bool


def site_rule(verdict: str, host: str, path: str) -> Rule:
    return Rule(verdict, host + path, (f"{host}{path}**", f"*.{host}{path}**"), True)


#: The rules that the query's contract states.
SITE_RULES = (
    site_rule("allow", "org", "/"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)
#: The operator's own globs, for URLs that no site rule fits: ``*`` stays within a part of the path, ``**`` doesn't, ``?`` is one character.
GLOBS = (
    Rule("block", "spam", ("*spam*/**", "*cheap-*/**", "*casino*/**", "*-pills*/**"), False),
    Rule("block", "service", ("**/login**", "**/signup**", "**/cart/**", "**/wp-admin/**"), False),
    Rule("block", "media", ("**.jpg", "**.png", "**.gif", "**.zip", "**.exe", "**.mp?"), False),
)


class Globs:
    """Extended Shift-And over several 64-bit words.

    A pattern with m plain tokens has m + 1 bits: bit i says that i tokens have matched.  A character moves bit
    i - 1 to i where it fits token i, and keeps bit i where a star behind token i accepts it.
    """

    def __init__(self, patterns: list[str]):
        parsed = []
        for pattern in patterns:
            plain: list[str] = []
            stars = {}
            k = 0
            while k < len(pattern):
                if pattern.startswith("**", k):
                    stars[len(plain)], k = "**", k + 2
                elif pattern[k] == "*":
                    stars[len(plain)], k = stars.get(len(plain), "*"), k + 1
                else:
                    plain.append(pattern[k])
                    k += 1
            parsed.append((plain, stars))
        letters = sorted({c for plain, _ in parsed for c in plain if c != "?"} | {"/"})
        self.letters = {c: i + 1 for i, c in enumerate(letters)}  # class 0: any other character
        self.lookup = np.zeros(max(map(ord, letters)) + 2, np.int64)
        for c, i in self.letters.items():
            self.lookup[ord(c)] = i
        bits = sum(len(plain) + 1 for plain, _ in parsed)
        self.words = -(-bits // 64)
        self.step = np.zeros((len(letters) + 1, self.words), np.uint64)
        self.loop = np.zeros_like(self.step)
        self.start = np.zeros(self.words, np.uint64)
        self.ends = []
        at = 0
        for plain, stars in parsed:
            self._set(self.start, at)
            for i in range(len(plain) + 1):
                for cls in range(len(letters) + 1):
                    if i and (plain[i - 1] == "?" or self.letters.get(plain[i - 1]) == cls):
                        self._set(self.step[cls], at + i)
                    if i in stars and (stars[i] == "**" or cls != self.letters["/"]):
                        self._set(self.loop[cls], at + i)
            at += len(plain) + 1
            self.ends.append(at - 1)

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1 << (bit % 64))

    def match(self, texts: list[str]) -> np.ndarray:
        """A boolean for each text and pattern."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.lookup[np.minimum(flat, len(self.lookup) - 1)]
        begins = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for k in range(int(lengths[0]) if len(texts) else 0):
            live = int(np.searchsorted(-lengths, -k, side="left"))  # those longer than k
            cls, now = classes[begins[:live] + k], state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.step[cls]) | (now & self.loop[cls])
        out = np.empty((len(texts), len(self.ends)), bool)
        out[order] = np.stack([(state[:, e // 64] >> np.uint64(e % 64)) & one for e in self.ends], 1).astype(bool)
        return out


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules: tuple[Rule, ...] = SITE_RULES, globs: tuple[Rule, ...] = GLOBS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    The longest site rule that fits decides; else the first glob that fits; else ``default``.  A null URL, or one
    without ``://``, has an empty host and path, which no rule fits, so it gets ``default``.  Repeated rows and
    null ids give a row each; an empty table gives none.  Other columns are ignored.
    """
    if any(r.name == s.name and r.verdict != s.verdict for r in site_rules for s in site_rules):
        raise ValueError("two site rules of one name have different verdicts")
    ranked = sorted(site_rules, key=lambda r: -len(r.name)) + list(globs)

    def make():
        machine = Globs([g for r in ranked for g in r.globs])
        of_rule = np.repeat(np.arange(len(ranked)), [len(r.globs) for r in ranked])
        names = np.array([r.name if r.site else None for r in ranked] + [None], object)
        verdicts = np.array([r.verdict for r in ranked] + [default], object)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hit = machine.match([h + p for h, p in zip(host, path, strict=True)])
            first = np.where(hit.any(1), of_rule[np.argmax(hit, 1)], len(ranked)) if len(host) else np.zeros(0, int)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(names[first], pa.string()), pa.array(verdicts[first], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

        return step

    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    parts = pages.select(F.col(id_col).alias("page_id"), rest.alias("rest"))
    parts = parts.select("page_id", ascii_lower(F.regexp_extract("rest", r"\A([^/?#]*)", 1)).alias("host"), F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1).alias("path"))
    id_type = dict(parts.dtypes)["page_id"]
    return per_batch(parts, f"page_id {id_type}, host string, path string, rule string, verdict string", make)


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN path <> '' AND regexp_matches(host, 'spam|cheap-|casino|-pills') THEN 'block'
    WHEN regexp_matches(host || path, '(?s)/login|/signup|/cart/|/wp-admin/') THEN 'block'
    WHEN regexp_matches(host || path, '(?s)\.(jpg|png|gif|zip|exe|mp.)\z') THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
