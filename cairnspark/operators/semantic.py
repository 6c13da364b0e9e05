"""Search modes: a plug-in for other rankers, fallback to lexical search, and brute-force vectors as a backend."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search as lexical

API_VERSION, INDEX_VERSION = "1", 2
MODES, METRICS = ("lexical", "semantic"), ("cosine", "dot", "l2")


@dataclass
class Backend:
    """A ranker: ``function(query, archive, limit)`` gives rows of entry_id, path, excerpt, score, matched_terms."""

    function: Callable | None
    supported: bool = True
    api_version: str = API_VERSION
    index_version: int = INDEX_VERSION
    descriptor: dict = field(default_factory=dict)

    def problem(self) -> str | None:
        """Why it can't be used, or None."""
        if not self.supported:
            return "backend-not-supported"
        if self.api_version != API_VERSION:
            return "backend-api-version"
        if self.index_version != INDEX_VERSION:
            return "backend-index-version"
        return None if callable(self.function) else "backend-function-missing"

    def ask(self, query: str, archive: str, limit: int) -> list[dict]:
        try:
            inspect.signature(self.function).bind(query=query, archive=archive, limit=limit)
        except TypeError:
            rows = self.function(query, archive, limit)
        else:
            rows = self.function(query=query, archive=archive, limit=limit)
        filled = [{"excerpt": "", "score": 0.0, "matched_terms": ""} | dict(r) for r in rows]
        return [r | {"score": float(r["score"] or 0.0), "excerpt": r["excerpt"] or ""} for r in filled][:limit]


def probe(module: str, attribute: str = "SEARCH_CAPABILITIES") -> tuple[Backend | None, list[str]]:
    """The backend that an importable module offers, and what stands in the way of using it.

    The module has a mapping, or a function that gives one, with supported, api_version, index_version, descriptor and
    function (a callable, or the name of one in the module).
    """
    try:
        found = importlib.import_module(module)
    except Exception as error:  # noqa: BLE001  a broken plug-in must not end the engine
        return None, [f"{module} can't be imported: {type(error).__name__}: {error}"]
    offer = getattr(found, attribute, None)
    try:
        offer = offer() if callable(offer) else offer
    except Exception as error:  # noqa: BLE001
        return None, [f"{module}.{attribute} fails: {type(error).__name__}: {error}"]
    if not isinstance(offer, dict):
        return None, [f"{module} has no {attribute}"]
    function = offer.get("function")
    function = getattr(found, function, None) if isinstance(function, str) else function
    backend = Backend(function, offer.get("supported") is True, str(offer.get("api_version")), offer.get("index_version", 0), offer.get("descriptor") or {})
    problem = backend.problem()
    return backend, [] if problem is None else [f"{module}: {problem} (wanted API {API_VERSION}, index version {INDEX_VERSION})"]


def required(module: str) -> Backend:
    """The backend of a module, or an error that says why it can't be used."""
    backend, problems = probe(module)
    if problems:
        raise MismatchError("; ".join(problems))
    return backend


@dataclass
class Answer:
    results: DataFrame
    mode_requested: str
    mode_used: str
    fallback_reason: str | None


class MismatchError(RuntimeError):
    """A remote backend named an entry that the archive doesn't have."""


def _wrong(rows: list[dict], documents: DataFrame) -> bool:
    asked = documents.sparkSession.createDataFrame([(str(r.get("entry_id")), str(r.get("path"))) for r in rows], "entry_id string, path string")
    return not asked.join(documents.select("entry_id", "path"), ["entry_id", "path"], "left_anti").isEmpty()


def answer(documents: DataFrame, query: str, limit: int = lexical.DEFAULT_LIMIT, mode: str = "lexical", backend: Backend | None = None, archive: str = "", remote: bool = False, declared_ready: bool = False) -> Answer:
    """Results of a mode; semantic search falls back to lexical and says why.

    Wrong ids make a local backend fall back and a remote one raise.
    """
    if mode not in MODES:
        raise lexical.SearchError(f"unknown mode {mode!r}")
    limit = lexical.checked_limit(limit)
    fall = lambda reason: Answer(lexical.search(documents, query, limit), mode, "lexical", reason)
    if mode == "lexical":
        return fall(None)
    if backend is None:
        return fall("declared-backend-missing" if declared_ready else "backend-missing")
    if reason := backend.problem():
        return fall(reason)
    try:
        rows = backend.ask(query, archive, limit)
    except Exception as error:  # the plug-in is foreign code: any failure of it means lexical results
        return fall(f"backend-failed: {type(error).__name__}")
    if rows and _wrong(rows, documents):
        if remote:
            raise MismatchError("the backend named an entry that the archive doesn't have")
        return fall("backend-wrong-entry")
    names = ("entry_id", "path", "excerpt", "score", "matched_terms")
    ordered = [(k, *(r[n] for n in names)) for k, r in enumerate(rows)]
    out = documents.sparkSession.createDataFrame(ordered, "rank int, entry_id string, path string, excerpt string, score double, matched_terms string")
    return Answer(out.orderBy("rank").drop("rank"), mode, "semantic", None)


def vector_score(vector: Column, query: list[float], metric: str) -> Column:
    """Similarity of a vector column to a query (for l2 the negative distance), in double precision."""
    if metric not in METRICS:
        raise lexical.SearchError(f"unknown metric {metric!r}")
    other = F.array(*(F.lit(float(x)) for x in query))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    own = F.transform(vector, lambda x: x.cast("double"))
    if metric == "l2":
        return -F.sqrt(total(F.zip_with(own, other, lambda a, b: (a - b) * (a - b))))
    dot = total(F.zip_with(own, other, lambda a, b: a * b))
    if metric == "dot":
        return dot
    norm = F.sqrt(total(F.transform(own, lambda x: x * x)))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when((norm == 0) | F.lit(length == 0), F.lit(0.0)).otherwise(dot / norm / F.lit(length or 1.0))


def vector_topk(vectors: DataFrame, query: list[float], metric: str = "cosine", limit: int = 10) -> DataFrame:
    """vec_id, score of the nearest vectors; a scan that keeps each task's best."""
    scored = vectors.select("vec_id", F.bround(vector_score(F.col("embedding"), query, metric), 4).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(limit)
