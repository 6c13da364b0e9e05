"""Benchmark decontamination: suffix arrays of training shards, searched for every test suffix."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, map_arrow, slices

WINDOW = 10
ID_BITS = 21  # three word ids in a 64-bit key
LAST = (1 << ID_BITS) - 1  # stands behind the end of an item; no word has it
KEYS = -(-WINDOW // 3)
SHARD_BYTES = 4_000_000
BLOCK_WORDS = 1_000_000  # suffixes of test items in one block; so it has fewer than 2 ** ID_BITS distinct words
PASS_BLOCKS = 4  # blocks that are searched in one pass over the documents
RUNS = "array<struct<s:long,e:long>>"
LONGEST = "struct<words:long,at:long,item:string,item_at:long>"
#: A-Z to a-z; letters, digits and every byte of a non-ASCII character stay; all else parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def packed(columns: list[np.ndarray], fill: int) -> np.ndarray:
    """Rows of word ids as KEYS 64-bit numbers; ``fill`` stands for missing columns."""
    size = len(columns[0])
    columns = columns + [np.full(size, fill, np.int64)] * (3 * KEYS - len(columns))
    return np.stack([(columns[k] << (2 * ID_BITS)) | (columns[k + 1] << ID_BITS) | columns[k + 2] for k in range(0, 3 * KEYS, 3)], 1)


def ordered(keys: np.ndarray) -> np.ndarray:
    """Keys as byte strings that sort as the rows do."""
    return np.ascontiguousarray(keys.astype(">u8")).view(f"S{8 * KEYS}").ravel()


@dataclass
class Part:
    """Suffixes of one item from word ``first`` on: ``count`` of them, with the WINDOW - 1 words behind the last one."""

    name: str
    words: list[bytes]
    first: int
    count: int
    item_words: int


@dataclass
class TestSuffixes:
    """The suffixes of a block of test items: sorted for longest matches, and those that begin a window as search bounds."""

    vocabulary: dict[bytes, int]
    names: list[str]
    item: np.ndarray  # of each window: item, its first word, width, bounds of the search
    at: np.ndarray
    width: np.ndarray
    low: np.ndarray
    high: np.ndarray
    heads: tuple[np.ndarray, ...]  # first one, two or three words of the suffixes that a search looks for
    keys: np.ndarray  # sorted suffixes, their items and first words
    key_item: np.ndarray
    key_at: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray]  # two words that follow each other, and a suffix that begins with them
    single: np.ndarray  # a suffix for each word; -1 for words that begin none in this block

    @classmethod
    def of(cls, parts: list[Part]) -> TestSuffixes:
        names = sorted({p.name for p in parts})
        number = {name: k for k, name in enumerate(names)}
        vocabulary: dict[bytes, int] = {}
        ids, item, at, width, start = [], [], [], [], 0
        starts = []
        for p in parts:
            ids += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in p.words] + [LAST] * WINDOW
            starts.append(start + np.arange(p.count))
            start += len(p.words) + WINDOW
            item.append(np.full(p.count, number[p.name]))
            at.append(p.first + np.arange(p.count))
            wide = min(WINDOW, p.item_words)
            width.append(np.where(p.first + np.arange(p.count) + wide <= p.item_words, wide, 0))
        join = lambda found: np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
        flat, starts, item, at, width = np.array(ids, np.int64), join(starts), join(item), join(at), join(width)
        table = [flat[starts + k] for k in range(WINDOW)] if len(starts) else [np.zeros(0, np.int64)] * WINDOW
        window = width > 0
        inside = [np.arange(WINDOW)[k] < width[window] for k in range(WINDOW)]
        low = ordered(packed([np.where(i, c[window], 0) for i, c in zip(inside, table, strict=True)], 0))
        high = ordered(packed([np.where(i, c[window], LAST) for i, c in zip(inside, table, strict=True)], LAST))
        head = packed(table[:3], 0)[:, 0]
        short = [window & (width == n) for n in (1, 2)]
        heads = tuple(np.unique(h) for h in (head[short[0]] >> (2 * ID_BITS) << (2 * ID_BITS), head[short[1]] >> ID_BITS << ID_BITS, head[table[2] != LAST]))
        keys = ordered(packed(table, 0))
        order = np.argsort(keys, kind="stable")
        pair = np.flatnonzero(table[1] != LAST)
        two, which = np.unique((table[0] << ID_BITS | table[1])[pair], return_index=True)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        single = np.full(len(vocabulary) + 1, -1, np.int64)
        single[table[0][::-1]] = rank[::-1]
        return cls(vocabulary, names, item[window], at[window], width[window], low, high, heads, keys[order], item[order], at[order], (two, rank[pair[which]]), single)


def suffix_array(ids: np.ndarray, heads: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the training suffixes in sorted order, with their sort keys.

    Suffixes are ordered by their first WINDOW words; longer matches are runs of these.  A suffix whose first three
    words (or all words of a shorter test item) begin no test suffix matches none in three words and is left out.
    """
    at = np.flatnonzero(ids[:-WINDOW])
    keep = np.zeros(len(at), bool)
    if at.size:
        first, second, third = ids[at], ids[at + 1], ids[at + 2]
        head = packed([first], 0)[:, 0]
        for width, known in enumerate(heads, 1):
            if width == 2:
                head = head | (second << ID_BITS)
            elif width == 3:
                head = head | third
            if known.size:
                keep |= known[np.minimum(np.searchsorted(known, head), len(known) - 1)] == head
    at = at[keep]
    keys = packed([ids[at + k] for k in range(WINDOW)], 0)
    order = np.lexsort(keys.T[::-1])
    return at[order], ordered(keys[order])


def common_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first words two rows of keys share, WINDOW at most."""
    x, y = (k.view(">u8").astype(np.uint64).reshape(-1, KEYS) for k in (a, b))
    same, out = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for k in range(WINDOW):
        shift = np.uint64(ID_BITS * (2 - k % 3))
        same &= (x[:, k // 3] >> shift & np.uint64(LAST)) == (y[:, k // 3] >> shift & np.uint64(LAST))
        out += same
    return out


@dataclass
class Matches:
    """For each text of a shard: hit runs of words, items that occur, and the longest verbatim match.

    A match is (words, first word in the text, item, first word in the item).
    """

    n_words: list[int]
    runs: list[list[tuple[int, int]]]
    items: list[list[str]]
    longest: list[tuple[int, int, str | None, int]]


def search_shard(texts: list[str | None], tests: TestSuffixes) -> Matches:
    get = tests.vocabulary.get
    split = [words(t) for t in texts]
    n_words = [len(w) for w in split]
    begins = np.cumsum([0] + [n + WINDOW for n in n_words])  # WINDOW zeros part the texts
    ids = np.zeros(int(begins[-1]) + WINDOW, np.int64)
    for begin, w in zip(begins, split, strict=False):
        ids[begin : begin + len(w)] = [get(x, 0) for x in w]
    del split
    out = Matches(n_words, [[] for _ in texts], [[] for _ in texts], [(0, 0, None, 0)] * len(texts))
    if not len(tests.keys):
        return out

    def best(where: np.ndarray, length: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        """Of each text's matches the longest, the first of them if there are several."""
        text = np.searchsorted(begins, where, "right") - 1
        order = np.lexsort((where, -length, text))
        for k in order[np.r_[True, np.diff(text[order]) != 0]] if len(order) else ():
            t = int(text[k])
            if length[k] > out.longest[t][0]:
                out.longest[t] = int(length[k]), int(where[k] - begins[t]), tests.names[item[k]], int(at[k])

    array, keys = suffix_array(ids, tests.heads)
    first, last = np.searchsorted(keys, tests.low, "left"), np.searchsorted(keys, tests.high, "right")
    found = np.maximum(last - first, 0)
    if found.any():
        suffix = np.repeat(np.arange(len(found)), found)
        where = array[np.arange(len(suffix)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(first, found)]
        text = np.searchsorted(begins, where, "right") - 1
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, where, 1)
        np.add.at(edge, where + tests.width[suffix], -1)
        hit = np.flatnonzero(np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0, append=0))
        for s, e in hit.reshape(-1, 2):
            k = int(np.searchsorted(begins, s, "right")) - 1
            out.runs[k].append((int(s - begins[k]), int(e - begins[k])))
        for pair in np.unique(text * len(tests.names) + tests.item[suffix]):
            out.items[pair // len(tests.names)].append(tests.names[pair % len(tests.names)])
        # windows that follow each other in both the item and the text are one verbatim match
        lane = where - tests.at[suffix]
        order = np.lexsort((where, lane, tests.item[suffix]))
        where, lane, item, width, at = where[order], lane[order], tests.item[suffix][order], tests.width[suffix][order], tests.at[suffix][order]
        new = np.r_[True, (np.diff(where) != 1) | (np.diff(lane) != 0) | (np.diff(item) != 0)]
        start = np.flatnonzero(new)
        best(where[start], np.diff(np.r_[start, len(where)]) - 1 + width[start], item[start], at[start])
    # shorter matches: a training suffix shares most words with one of its neighbours among the test suffixes
    spot = np.searchsorted(tests.keys, keys)
    for near in (np.maximum(spot - 1, 0), np.minimum(spot, len(tests.keys) - 1)):
        length = common_words(keys, tests.keys[near])
        best(array[length > 0], length[length > 0], tests.key_item[near][length > 0], tests.key_at[near][length > 0])
    owner = np.repeat(np.arange(len(texts)), np.diff(begins))
    for size in (2, 1):
        left = np.array([n[0] < size for n in out.longest])
        if not left.any():
            break
        where = np.flatnonzero(ids[: len(owner)])
        where = where[left[owner[where]]]
        if size == 2:
            known, suffix = tests.pairs
            if not len(known):
                continue
            pair = ids[where] << ID_BITS | ids[where + 1]
            near = np.minimum(np.searchsorted(known, pair), len(known) - 1)
            suffix = np.where(known[near] == pair, suffix[near], -1)
        else:
            suffix = tests.single[ids[where]]
        where, suffix = where[suffix >= 0], suffix[suffix >= 0]
        first = np.flatnonzero(np.diff(owner[where], prepend=-1))  # of each text
        best(where[first], np.full(len(first), size), tests.key_item[suffix[first]], tests.key_at[suffix[first]])
    return out


def parts_of(name: str, item_words: list[bytes], most: int):
    """The suffixes of an item in parts of at most ``most``."""
    for first in range(0, len(item_words), most):
        count = min(most, len(item_words) - first)
        yield Part(name, item_words[first : first + count + WINDOW - 1], first, count, len(item_words))


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """Test items in blocks of at most ``block_words`` suffixes, whatever the size of an item; one block is held at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    held: list[Part] = []
    size = 0
    for row in items.toLocalIterator():
        for part in parts_of(row["item"], words(row["text"]), block_words):
            if held and size + part.count > block_words:
                yield TestSuffixes.of(held)
                held, size = [], 0
            held.append(part)
            size += part.count
    yield TestSuffixes.of(held)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, added: tuple[str, str, str, str], text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with four columns added: words, runs of hit words, items and the longest match, by the names in ``added``.

    No column of ``docs`` may have such a name; ``common.fresh`` gives names that are free.  The benchmark is taken
    in blocks of bounded size; a block's suffixes go to every task, and each task searches them in the suffix arrays
    of its own shards.  PASS_BLOCKS blocks are searched in one pass, each by a worker of its own; between passes, that
    is for benchmarks of more than PASS_BLOCKS * BLOCK_WORDS words, there is a checkpoint.  No row is shuffled.
    Columns of ``docs`` keep their names and values.
    """
    start = [F.lit(0).cast("long"), F.array().cast(RUNS), F.array().cast("array<string>"), F.lit(None).cast(LONGEST)]
    state = docs.withColumns(dict(zip(added, start, strict=True)))
    schema, text_at = state.schema, docs.columns.index(text_col)
    for number, tests in enumerate(blocks_of(benchmark, item_id_col, item_text_col, block_words)):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, batch.schema.field(text_at).name, SHARD_BYTES):
                    found = search_shard(part.column(text_at).to_pylist(), shared.value)
                    old_runs, old_items, old_longest = (part.column(part.num_columns - k).to_pylist() for k in (3, 2, 1))
                    runs = [[{"s": s, "e": e} for s, e in union([(r["s"], r["e"]) for r in old] + new)] for old, new in zip(old_runs, found.runs, strict=True)]
                    items = [sorted({*old, *new}) for old, new in zip(old_items, found.items, strict=True)]
                    longest = [old if (old or {"words": 0})["words"] >= new[0] else dict(zip(("words", "at", "item", "item_at"), new, strict=True)) for old, new in zip(old_longest, found.longest, strict=True)]
                    kinds = batch.schema.types[-4:]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-4], *(pa.array(x, k) for x, k in zip([found.n_words, runs, items, longest], kinds, strict=True))], schema=batch.schema)

        if number and number % PASS_BLOCKS == 0:
            state = durable(state)
        state = map_arrow(state, run, schema)
    return state


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


ADDED = ("cairn_words", "cairn_runs", "cairn_items", "cairn_longest")


def decontamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and where the longest verbatim match stands:
    longest (words), longest_at (its first word in the text), longest_item, longest_item_at, for every row of ``docs``.

    A window is WINDOW consecutive words of an item, or the whole of a shorter item; a word inside any occurrence
    of a window is hit.  The longest match counts from one word on, whether or not it holds a window; of matches of
    one length the first in the text is given, with any of the items that hold it.  Null or wordless texts have no
    words and null or wordless items no windows.  Very long texts are a shard, and very long items several parts, of
    their own.  Item rows with one id count as one item; a null item_id is the empty string.  Null doc_ids and
    repeated rows give a row each; an empty table gives none, and an empty benchmark leaves all rows clean.  Other
    columns are ignored.
    """
    rows = match_benchmark(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, ADDED, **sizes).drop("text")
    n_hit = F.aggregate("cairn_runs", F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["s"])
    longest = F.col("cairn_longest")
    return rows.select(
        "doc_id", F.col("cairn_words").alias("n_words"), n_hit.alias("n_hit"), F.size("cairn_items").cast("long").alias("n_items"), F.sha2(F.array_join("cairn_items", ","), 256).alias("items_sha256"), (F.size("cairn_runs") > 0).alias("contaminated"),
        F.coalesce(longest["words"], F.lit(0)).cast("long").alias("longest"), longest["at"].alias("longest_at"), longest["item"].alias("longest_item"), longest["item_at"].alias("longest_item_at"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their own columns, whatever their names.  Edge cases as in the report."""
    added = fresh(docs.columns, *ADDED)
    return match_benchmark(docs, benchmark, added, text_col).where(F.size(F.col(added[1])) == 0).drop(*added)


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w, least({WINDOW}, len(w)) AS width FROM benchmark),
win AS (SELECT DISTINCT item, width, array_to_string(list_slice(w, k, k + width - 1), ' ') AS words
        FROM (SELECT item, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM i WHERE width > 0)),
pos AS (SELECT r, width, k, array_to_string(list_slice(w, k, k + width - 1), ' ') AS words
        FROM (SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS k FROM d, (SELECT DISTINCT width FROM win) WHERE len(w) >= width)),
hits AS (SELECT r, width, k, item FROM pos JOIN win USING (width, words)),
n AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(k, k + width)) AS spot FROM hits) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN o USING (r)
"""


def brute_force(text: str | None, items: list[tuple[str, str | None]]) -> tuple[int, int, int, str]:
    """n_words, n_hit, n_items, items_sha256 straight from the definition; for tests."""
    doc, hit, names = words(text), set(), set()
    for name, item in items:
        item_words = words(item)
        width = min(WINDOW, len(item_words))
        for k in range(len(item_words) - width + 1 if item_words else 0):
            for at in range(len(doc) - width + 1):
                if doc[at : at + width] == item_words[k : k + width]:
                    hit.update(range(at, at + width))
                    names.add(name)
    return len(doc), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def longest_match(text: str | None, items: list[tuple[str, str | None]]) -> int:
    """Words of the longest verbatim match, straight from the definition; for tests."""
    doc, most = words(text), 0
    for _, item in items:
        before = [0] * (len(doc) + 1)
        for w in words(item):
            before = [0] + [before[k] + 1 if doc[k] == w else 0 for k in range(len(doc))]
            most = max(most, *before)
    return most
