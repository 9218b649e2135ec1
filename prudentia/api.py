"""The questions users ask, answered as plain dictionaries.

Each answer is the rows of a bounded query: one ruling, one page of a listing,
one chain of at most ``MAX_STEPS`` steps.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudentia.operators import listing, resolve, signals, trace
from prudentia.schema import MAX_DEPTH, MAX_QUERY, MAX_STEPS, SIGNALS, TREATMENTS
from prudentia.sources.store import GraphStore

#: Characters of a passage that a chain shows.
TRACE_QUOTE = 320


class NotFound(LookupError):
    """A form that no ruling answers to; the message says what might be meant."""


@dataclass(frozen=True)
class Page:
    total: int
    offset: int
    items: list[dict[str, Any]]

    def as_dict(self) -> dict[str, Any]:
        after = self.offset + len(self.items)
        more = bool(self.items) and after < self.total
        return {"total": self.total, "count": len(self.items), "offset": self.offset, "has_more": more, "next_offset": after if more else None, "items": self.items}


def trimmed(quote: str) -> str:
    """A passage as a chain shows it, marked where it was shortened."""
    passage = " ".join(quote.split())
    return passage if len(passage) <= TRACE_QUOTE else passage[:TRACE_QUOTE].rstrip() + "… [pasaje recortado]"


def parse_treatment(raw: str | None) -> str | None:
    name = (raw or "").strip().lower()
    if name and name not in TREATMENTS:
        raise ValueError(f"no treatment {raw!r}; there are {', '.join(TREATMENTS)}")
    return name or None


class CitationGraph:
    """A citation graph to ask."""

    def __init__(self, rulings: DataFrame, citations: DataFrame, aliases: DataFrame):
        self.rulings, self.citations, self.aliases = rulings, citations, aliases
        self._spark = rulings.sparkSession

    # What the questions about one ruling read; a stored graph opens less for them.

    def _ruling(self, ident: str) -> DataFrame:
        return self.rulings.where(F.col("id") == ident)

    def _edges_to(self, ident: str) -> DataFrame:
        return self.citations.where(F.col("cited_id") == ident)

    def _edges_from(self, ident: str) -> DataFrame:
        return self.citations.where(F.col("citing_id") == ident)

    def _names_of(self, ident: str) -> DataFrame:
        return self.aliases.where(F.col("ruling_id") == ident)

    def _among(self, edges: DataFrame, column: str, *more: str) -> DataFrame:
        """Rulings, at least those that ``column`` of the edges and ``more`` name."""
        return self.rulings

    def _stamp(self) -> dict[str, str]:
        return {}

    def _id(self, query: str) -> str:
        if not query or not query.strip():
            raise ValueError("an empty query")
        if len(query) > MAX_QUERY:
            raise ValueError(f"a query has {MAX_QUERY} characters at most")
        asked = self._spark.createDataFrame([(0, query)], "query long, raw string")
        found = resolve.resolve(asked, "raw", self.rulings, self.aliases).first().resolved
        if found is None:
            near = [r.id for r in resolve.suggest(asked, "raw", self.rulings, 3).orderBy("rank").collect()]
            raise NotFound(f"no ruling {query!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        return found

    def lookup(self, query: str) -> dict[str, Any]:
        ident = self._id(query)
        row = self._ruling(ident).first().asDict()
        names = self._names_of(ident).orderBy("form", "raw").limit(100).collect()
        return row | {"aliases": [r.raw for r in names]}

    def status(self, query: str) -> dict[str, Any]:
        """The signal with its counts, caveats and gravest passages."""
        ident = self._id(query)
        one, edges = self._ruling(ident), self._edges_to(ident)
        rulings = self._among(edges, "citing_id", ident)
        report = signals.caveats(signals.signals(rulings, edges).where(F.col("id") == ident)).first().asDict(recursive=True)
        passages = signals.evidence(rulings, edges).orderBy("rank").select("rank", "citing_id", "treatment", "opinion", "confidence", "method", "year", "quote").collect()
        counts = signals.treatment_counts(edges).collect()
        others = signals.nonbinding_by_opinion(edges).collect()
        shown = {k: v for k, v in report.items() if k != "newest"}
        return one.first().asDict() | shown | {"label": SIGNALS[report["signal"]], "by_treatment": {r.treatment: r.n for r in counts}, "nonbinding_by_opinion": {r.opinion: r.n for r in others}, "corpus": self.corpus(), "binding_by_treatment": {r.treatment: r.n_binding for r in counts if r.n_binding}, "evidence": [r.asDict() for r in passages]}

    def citing(self, query: str, treatment: str | None = None, offset: int = 0, limit: int | None = None) -> dict[str, Any]:
        ident, kind = self._id(query), parse_treatment(treatment)
        limit, offset = listing.clamp(limit, offset)
        edges = self._edges_to(ident)
        edges = edges if kind is None else edges.where(F.col("treatment") == kind)
        total = edges.agg(F.countDistinct("citing_id")).first()[0]
        return Page(total, offset, [r.asDict() for r in listing.citing_page(edges, self._among(edges, "citing_id"), ident, kind, offset, limit).collect()]).as_dict()

    def cited(self, query: str, offset: int = 0, limit: int | None = None) -> dict[str, Any]:
        ident = self._id(query)
        limit, offset = listing.clamp(limit, offset)
        edges = self._edges_from(ident)
        total = edges.agg(F.countDistinct("cited_id")).first()[0]
        return Page(total, offset, [r.asDict() for r in listing.cited_page(edges, self._among(edges, "cited_id"), ident, offset, limit).collect()]).as_dict()

    def trace(self, query: str, max_depth: int = 3) -> dict[str, Any]:
        """How later rulings treated a doctrine, step by step, with the signals of the
        rulings shown and how many of all reached ones have which."""
        ident, depth = self._id(query), min(max(max_depth, 1), MAX_DEPTH)
        steps = trace.trace_steps(self.citations, self.rulings, ident, depth)
        first = trace.chain(steps, MAX_STEPS + 1).collect()
        omitted = steps.count() - MAX_STEPS if len(first) > MAX_STEPS else 0
        shown = first[:MAX_STEPS]
        named = sorted({ident, *(r.from_id for r in shown), *(r.to_id for r in shown)})
        lights = signals.signals(self.rulings, self.citations.where(F.col("cited_id").isin(named))).where(F.col("id").isin(named)).select("id", "signal").collect()
        reached = {r.signal: r.n for r in self.trace_signals(query, depth).groupBy("signal").agg(F.count("*").alias("n")).collect()}
        return {"start": ident, "max_depth": depth, "reached": sum(reached.values()), "reached_by_signal": reached, "steps": [r.asDict() | {"quote": trimmed(r.quote)} for r in shown], "omitted": omitted, "signals": {r.id: r.signal for r in lights}}

    def trace_signals(self, query: str, max_depth: int = 3) -> DataFrame:
        """(id, signal) of every ruling that a trace reaches, not only of those in
        the shown steps: as many as the graph has, so they stay a DataFrame."""
        ident, depth = self._id(query), min(max(max_depth, 1), MAX_DEPTH)
        seen = trace.reached(trace.moving(self.citations, self.rulings), ident, depth).select("id")
        edges = self.citations.join(seen.withColumnRenamed("id", "cited_id"), "cited_id", "left_semi")
        return signals.signals(self.rulings, edges).join(seen, "id", "left_semi").select("id", "signal")

    def corpus(self) -> dict[str, Any]:
        states = {r.text_status: r.n for r in listing.status_counts(self.rulings).collect()}
        return {"rulings": sum(states.values()), "citations": self.citations.count(), "by_status": states} | self._stamp()


class StoredGraph(CitationGraph):
    """The graph of a store: questions about one ruling open the ranges of it and of
    its neighbours."""

    def __init__(self, store: GraphStore):
        super().__init__(store.rulings, store.citations, store.aliases)
        self.store = store

    def _ruling(self, ident: str) -> DataFrame:
        return self.store.lookup("rulings", ident)

    def _edges_to(self, ident: str) -> DataFrame:
        return self.store.lookup("citations", ident)

    def _edges_from(self, ident: str) -> DataFrame:
        return self.store.lookup("citing", ident)

    def _among(self, edges: DataFrame, column: str, *more: str) -> DataFrame:
        named = edges.select(F.col(column).alias("id"))
        for ident in more:
            named = named.union(self._spark.range(1).select(F.lit(ident).alias("id")))
        return self.store.matching("rulings", named, "id")

    def _stamp(self) -> dict[str, str]:
        return {"commit": self.store.version} | self.store.meta


def as_json(answer: dict[str, Any]) -> str:
    return json.dumps(answer, ensure_ascii=False, indent=2, default=str)
