"""Language ID by cross-parsing: the language whose automaton needs the fewest phrases for a text wins."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, slices

UNKNOWN = "und"
BREAK, RARE = 0, 1  # symbols: between words, and any letter that no sample has
SEGMENT, MEET = 1024, 192
SLICE_BYTES = 4_000_000


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 and low.isalpha() else c
    return out


def folded(text: str) -> np.ndarray:
    """Lower-case letters of a text, with one 0 for each stretch of anything else."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return codes[(codes != 0) | (np.r_[1, codes[:-1]] != 0)] if len(codes) else codes


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return edges


class CrossParser:
    """The automata of all languages in one table: entry 2 * next state, plus 1 where a new phrase begins.

    Every letter that some sample has is a symbol.  The most frequent ``dense`` of them have a column of the table;
    transitions by the others are few for each state and stand in one sorted list.
    """

    def __init__(self, samples: dict[str, str], dense: int = 96):
        self.names = sorted(samples)
        texts = [folded(samples[n]) for n in self.names]
        seen, often = np.unique(np.concatenate([t[t != 0] for t in texts]), return_counts=True) if texts else (np.zeros(0, np.uint32), np.zeros(0, int))
        ordered = seen[np.argsort(-often, kind="stable")]
        self.width, self.symbols = min(len(ordered), dense) + 2, len(ordered) + 2
        self.symbol = np.full(0x110000, RARE, np.int32)
        self.symbol[0] = BREAK
        self.symbol[ordered] = np.arange(2, self.symbols)
        tables, base, keys, to = [], 0, [], []
        self.starts, self.anew = [], np.zeros((len(texts), self.symbols), np.int64)
        for k, t in enumerate(texts):
            edges = suffix_automaton(self.symbol[t].tolist())
            table = np.full((len(edges) + 1, self.width), -1, np.int64)  # the last state begins every phrase anew
            for state, out in enumerate(edges):
                for c, there in out.items():
                    if c < self.width:
                        table[state, c] = there
                    else:
                        keys.append((base + state) * self.symbols + c)
                        to.append(2 * (base + there))
            begin = np.array([edges[0].get(c, len(edges)) for c in range(self.symbols)])
            self.anew[k] = 2 * (base + begin) + 1
            tables.append(np.where(table < 0, self.anew[k, : self.width], 2 * (base + table)))
            self.starts.append(base + len(edges))
            base += len(table)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]

    def entries(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Entries of states[language, row] for the symbols of the rows."""
        if not len(self.keys):
            return self.table[state * self.width + symbol]
        out = self.table[state * self.width + np.where(symbol < self.width, symbol, RARE)].astype(np.int64)
        for k in np.flatnonzero(symbol >= self.width):
            wanted = state[:, k] * self.symbols + symbol[k]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[:, k] = np.where(self.keys[at] == wanted, self.to[at], self.anew[:, symbol[k]])
        return out

    def entry_of(self, state: int, symbol: int, language: int) -> int:
        if symbol < self.width:
            return int(self.table[state * self.width + symbol])
        at = int(np.searchsorted(self.keys, state * self.symbols + symbol))
        return int(self.to[at]) if at < len(self.keys) and self.keys[at] == state * self.symbols + symbol else int(self.anew[language, symbol])

    def phrases_of(self, symbols: list[int], language: int) -> int:
        """Phrases of one text, symbol by symbol."""
        state, count = self.starts[language], 0
        for c in symbols:
            entry = self.entry_of(state, c, language)
            count += entry & 1
            state = entry >> 1
        return count

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, symbols and letters by text; each text is parsed as a whole.

        All texts advance in lockstep, the long ones as segments.  A segment is parsed first as though it began a
        phrase; then once more from the state in which the segment before ended, until both parses are in one state,
        after which they are the same.  Where they don't meet within MEET symbols the text is parsed again in one go.
        """
        found = [folded(t or "") for t in texts]
        size = np.array([len(f) for f in found], np.int64)
        n_letters = np.array([np.count_nonzero(f) for f in found], np.int64)
        flat = self.symbol[np.concatenate(found)] if len(found) else np.zeros(0, np.int32)
        parts = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = (np.cumsum(size) - size)[owner] + nth * SEGMENT
        length = np.minimum(size[owner] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        languages = np.arange(len(self.names))
        state = np.repeat(np.array(self.starts, np.int64)[:, None], len(order), 1)
        count = np.zeros((len(self.names), len(order)), np.int64)
        spot = np.empty(len(order), np.int64)  # where a segment stands in the order by length
        spot[order] = np.arange(len(order))
        later = spot[np.flatnonzero(nth > 0)]  # segments that go on from another, in the order by length
        row = np.full(len(order), -1, np.int64)
        row[later] = np.arange(len(later))
        states, counts = [], []
        for k in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -k, side="left"))
            entry = self.entries(state[:, :live], flat[begin[:live] + k])
            count[:, :live] += entry & 1
            state[:, :live] = entry >> 1
            if k < MEET and len(later):
                states.append(state[:, later].astype(np.int32))
                counts.append(count[:, later].astype(np.int16))
        total = np.zeros((len(self.names), len(texts)), np.int64)
        text_of = owner[order]
        for lang in languages:
            np.add.at(total[lang], text_of, count[lang])
        if len(later):
            before = spot[np.flatnonzero(nth > 0) - 1]
            last = (nth + 1 == parts[owner])[nth > 0]
            now, own = state[:, before], np.zeros((len(self.names), len(later)), np.int64)
            apart = np.ones(now.shape, bool)
            for k, (theirs, their_count) in enumerate(zip(states, counts, strict=True)):
                on = np.flatnonzero(apart.any(0) & (length[later] > k))
                if not len(on):
                    break
                entry = self.entries(now[:, on], flat[begin[later[on]] + k])
                own[:, on] += entry & 1
                now[:, on] = entry >> 1
                met = apart[:, on] & ((now[:, on] == theirs[:, on]) | (last[on] & (length[later[on]] == k + 1)))
                apart[:, on] &= ~met
                for lang in languages:
                    np.add.at(total[lang], text_of[later[on]], np.where(met, own[:, on] - their_count[:, on], 0)[lang])
            for lang, j in {(int(a), int(text_of[later[b]])) for a, b in zip(*np.nonzero(apart), strict=True)}:
                total[lang, j] = self.phrases_of(self.symbol[found[j]].tolist(), lang)
        return total.T, size, n_letters

    def predict(self, texts: list[str | None], sharpness: float = 60.0) -> tuple[list[str], list[float]]:
        """Language and confidence: phrases per symbol, turned into shares that sum to 1 over the languages."""
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, size, n_letters = self.phrases(texts)
        rate = total / np.maximum(size, 1)[:, None]
        best = np.argmin(rate, 1)
        share = np.exp(-sharpness * (rate - rate.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        known = n_letters > 0
        return [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(s[b]) if k else 0.0 for s, b, k in zip(share, best, known, strict=True)]


@lru_cache(1)
def parser_of(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(dict(samples))


def is_training(id_col: str):
    """Whether the label of a row may be learned from; a null id may not."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2, F.lit(False))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, buckets: int, doc_chars: int, sample_chars: int, most_languages: int) -> tuple[tuple[str, str], ...]:
    """Labelled text of each language, ``sample_chars`` at most.

    For each language and each of ``buckets`` hash buckets of the id one row is drawn, by an aggregation that
    combines on the map side: of rows of at most ``doc_chars`` characters if there is one, and only else of longer
    ones, which are cut.  So what reaches the driver is bounded by most_languages * buckets * doc_chars.
    """
    rows = docs.where(is_training(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    drawn = F.struct((F.length(text_col) > doc_chars).alias("long"), F.xxhash64(F.col(id_col), F.lit("draw")).alias("draw"), F.substring(F.col(text_col), 1, doc_chars).alias("text"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(id_col), F.lit(buckets)).alias("bucket"), drawn.alias("one"))
    picked = rows.groupBy("lang", "bucket").agg(F.min("one").alias("one")).select("lang", "bucket", "one.text")
    samples: dict[str, str] = {}
    got = picked.limit(most_languages * buckets + 1).collect()
    if len(got) > most_languages * buckets or len({r["lang"] for r in got}) > most_languages:
        raise ValueError(f"{lang_col} has more than {most_languages} values, so it doesn't name languages")
    for r in sorted(got, key=lambda r: (r["lang"], r["bucket"])):
        samples[r["lang"]] = f"{samples.get(r['lang'], '')} {r['text']}"[:sample_chars]
    return tuple(sorted(samples.items()))


ADDED = ("cairn_lang", "cairn_score")


def with_language(docs: DataFrame, added: tuple[str, str] = ADDED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = 64, doc_chars: int = 4000, sample_chars: int = 40_000, most_languages: int = 200) -> DataFrame:
    """``docs`` with two columns added, language and score, by the names in ``added``, which ``docs`` must not have.

    The automata are learned from a sample of labelled rows (``buckets`` rows a language, of ``doc_chars`` characters
    if there are such, and ``sample_chars`` characters in all); every whole text is parsed.  No row is shuffled.
    """
    samples = learn(docs, id_col, text_col, lang_col, buckets, doc_chars, sample_chars, most_languages)
    state = docs.withColumns({added[0]: F.lit("").cast("string"), added[1]: F.lit(0.0)})
    text_at = docs.columns.index(text_col)

    def run(batches):
        parser = parser_of(samples)
        for batch in batches:
            for part in slices(batch, batch.schema.field(text_at).name, SLICE_BYTES):
                lang, score = parser.predict(part.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(lang, batch.schema.types[-2]), pa.array(score, batch.schema.types[-1])], schema=batch.schema)

    return map_arrow(state, run, state.schema)


def keep_known(docs: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with all their own columns, whatever their names."""
    added = fresh(docs.columns, *ADDED)
    return with_language(docs, added, **names).where(F.col(added[0]) != UNKNOWN).drop(*added)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sizes: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    ``und`` with score 0 stands for null and letterless texts, and for all texts where no row is labelled.  Equal
    phrase counts go to the language whose name sorts first.  Null ids are not held out but never learned from;
    repeated rows give a row each; an empty table gives none.  Very long texts are parsed whole, without a new phrase
    at any place where the parse itself has none.  Letters that no sample has are phrases of their own.  Other columns
    are ignored.
    """
    rows = with_language(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), **sizes)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), F.col("cairn_lang").alias("lang_pred"), F.col("cairn_score").alias("score"))
