"""The tools of the application as functions: they check bounds, build one plan and return plain values, with {"error": ...} instead of exceptions."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import classify
from ..operators import graph, manifest, retrieval, views
from ..sources.store import Store

MODES = ("hybrid", "chunks", "pages", "fts", "images", "assets")
# The least and the most of each tool's limit.
BOUNDS = {"search_evidence": (1, 25), "grep_evidence": (1, 100), "find_evidence_files": (1, 100), "check_document_status": (1, 100), "search_documents": (1, 100), "graph_top_k": (1, 50), "delegate_analysis": (1, 25)}


def plain(value):
    """Rows as dictionaries, to any depth."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def bounded(name: str, value: int) -> int:
    low, high = BOUNDS[name]
    if not low <= value <= high:
        raise ValueError(f"{name}: {value} is not within {low} and {high}")
    return value


def same_host(url: str, allowed: str) -> bool:
    """Whether a URL goes to exactly that host: a longer name that starts alike does not."""
    return urlparse(url).hostname == urlparse(allowed).hostname and urlparse(url).scheme == urlparse(allowed).scheme


def tool(f: Callable) -> Callable:
    @functools.wraps(f)
    def safe(*args, **kwargs):
        try:
            return f(*args, **kwargs)
        except Exception as problem:  # the contract of tools: errors are values
            return {"error": str(problem).splitlines()[0] if str(problem) else type(problem).__name__}

    return safe


@dataclass
class ViewChain:
    """Where views of documents come from: given ones (by the manifest's references), a cache as it is now, a parser of (key), and what keeps its views in the cache."""

    given: DataFrame
    cached: Callable[[], DataFrame]
    parse: Callable[[DataFrame], DataFrame]
    keep: Callable[[DataFrame], None]


class Tools:
    """The eleven tools over a manifest, evidence tables, parsed views and a graph. Models are injected callables."""

    def __init__(self, rows: DataFrame | None = None, evidence: dict[str, DataFrame] | None = None, pages: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, embed_text=None, embed_image=None, answer=None, vision=None, analyst=None, objects: DataFrame | None = None, chain: ViewChain | None = None, store: Store | None = None) -> None:
        self.manifest, self.evidence, self.parsed, self.nodes, self.edges = rows, evidence or {}, pages, nodes, edges
        self.objects, self.chain, self.store = objects, chain, store
        self.embed_text, self.embed_image, self.answer, self.vision, self.analyst = embed_text, embed_image, answer, vision, analyst

    @tool
    def corpus_overview(self) -> dict:
        out: dict = {}
        for r in manifest.overview(self.manifest).collect():
            out.setdefault(r.dimension, {})[r.value] = r.n
        return {"total": out.pop("total", {}).get("", 0), **out}

    @tool
    def search_documents(self, limit: int = 25, **filters) -> dict:
        total, rows = manifest.search_documents(self.manifest, limit=bounded("search_documents", limit), **filters)
        found = [plain(r) for r in rows.collect()]
        return {"total_matches": total.first().total_matches, "returned": len(found), "documents": found}

    def _row(self, key: str) -> dict:
        row = self.manifest.where(F.col("key") == key).drop("ordinal").first()
        if row is None:
            raise ValueError(f"unknown document key {key!r}")
        return plain(row)

    @tool
    def get_document_info(self, key: str) -> dict:
        """The manifest's row, the format, and what the listing (key, size, etag, ...) says of the object."""
        out = {**self._row(key), "gate": self.manifest.sparkSession.range(1).select(classify(F.lit(key))).first()[0]}
        if self.objects is not None:
            found = self.objects.where(F.col("key") == key).drop("key").first()
            out["object"] = plain(found) if found is not None else {"error": "no such object"}
        return out

    @tool
    def read_parsed_document(self, key: str, page_start: int = 1, page_end: int | None = None) -> dict:
        """Pages (key, page, markdown) within the budget of characters; a note if any are left out.

        With a chain, the document's view comes from its reference, else from the cache, else from a parse that is kept; ``source`` says
        which, and an extraction gives its fields and the pages that each field cites.
        """
        if page_start < 1 or (page_end is not None and page_end < 1):
            raise ValueError("pages count from 1")
        self._row(key)
        facts: dict = {}
        if self.chain is not None:
            asked = self.manifest.sparkSession.createDataFrame([(key,)], "key string")
            view = views.read_views(asked, self.chain.given, self.chain.cached(), self.chain.parse, self.chain.keep)
            row = view.withColumn("fields", F.to_json("fields")).select("kind", "source", "page_count", "fields", "field_pages").first()
            if row is None:
                raise ValueError(f"{key!r} can't be parsed")
            facts = {"kind": row.kind, "source": row.source, "page_count": row.page_count}
            if row.fields is not None:
                facts |= {"fields": json.loads(row.fields), "field_pages": row.field_pages or {}}
            mine = view.select("key", F.explode("pages").alias("p")).select("key", "p.page", "p.markdown")
        else:
            mine = self.parsed.where(F.col("key") == key)
        wanted = mine.where(F.col("page") >= page_start)
        wanted = wanted.where(F.col("page") <= page_end) if page_end is not None else wanted
        pages = [plain(r) for r in manifest.slice_pages(wanted, "key").orderBy("page").select("page", "markdown").collect()]
        left_out = wanted.count() - len(pages)
        return {"key": key, **facts, "pages": pages, **({"note": f"{left_out} more pages are beyond the budget: ask for later pages"} if left_out else {})}

    @tool
    def delegate_analysis(self, question: str, keys: list[str]) -> dict:
        """Files of the known documents go to the analyst, a callable (question, files) -> reply."""
        bounded("delegate_analysis", len(keys))
        spark = self.manifest.sparkSession
        asked = spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
        known = {r.key: r.known for r in manifest.split_known(asked, self.manifest.select("key")).collect()}
        mine = self.parsed.join(F.broadcast(asked), "key")
        files = {r.path: r.content for r in views.render_files(mine).collect()}
        seeded = {r.key for r in mine.select("key").distinct().collect()}
        reply = self.analyst(question, files) if self.analyst else "{}"
        found = spark.createDataFrame([(reply,)], "t string").select(F.to_json(views.parse_answer(F.col("t")))).first()[0]
        body = json.loads(found) if found else {"answer": reply, "notes": ["the reply held no JSON"]}
        cites = [c for c in body.get("citations") or [] if isinstance(c, dict) and isinstance(c.get("key"), str)]
        return {**body, "citations": cites, "seeded": sorted(seeded), "missing": sorted(k for k, ok in known.items() if ok and k not in seeded), "unknown_keys_skipped": sorted(k for k, ok in known.items() if not ok)}

    @tool
    def query_knowledge_graph(self, question: str, entity_scope: list[str] | None = None, top_k: int = 10) -> dict:
        """Edges around the entities that the question or the scope names, their source documents, and an answer from the injected model."""
        bounded("graph_top_k", top_k)
        words = [w for w in (entity_scope or question.split()) if len(w) > 2]
        named = self.nodes.where(F.lower("name").rlike("|".join(f"\\Q{w.lower()}\\E" for w in words)) if words else F.lit(False))
        around = graph.neighbours(self.edges, named.select("id"), 1).select("id").distinct()
        touched = self.edges.join(around.withColumnRenamed("id", "source"), "source", "left_semi").orderBy("source", "target", "label").limit(top_k)
        rows = touched.select("source", "target", "label", graph.tags(F.col("properties"), "s3key:").alias("keys"), graph.tags(F.col("properties"), "doc_id:").alias("docs")).collect()
        sources = list(dict.fromkeys(k for r in rows for k in r["keys"] or []))
        docs = list(dict.fromkeys(k for r in rows for k in r["docs"] or []))
        facts, mode = [f"{r.source} {r.label} {r.target}" for r in rows], "graph" if rows else "none"
        if not sources and "chunks" in self.evidence:
            # no source in the graph: ask the chunks
            hits = retrieval.search(self.evidence, question, "fts", top_k, self.embed_text).select("s3key", "doc_id", "text").collect()
            sources, docs = list(dict.fromkeys(h.s3key for h in hits)), list(dict.fromkeys(h.doc_id for h in hits))
            facts, mode = facts + [h.text for h in hits], "chunks" if hits else mode
        return {"answer": self.answer(question, facts) if self.answer else "; ".join(facts), "sources": sources, "evidence_doc_ids": docs, "mode": mode}

    @tool
    def search_evidence(self, query: str, mode: str = "hybrid", limit: int = 5, asset_team: str | None = None) -> dict:
        if mode not in MODES:
            raise ValueError(f"unknown search mode {mode!r}")
        hits = retrieval.search(self.evidence, query, mode, bounded("search_evidence", limit), self.embed_text, self.embed_image, asset_team)
        return {"mode": mode, "hits": [{**plain(h), "score": round(h.score, 4)} for h in hits.collect()]}

    @tool
    def grep_evidence(self, pattern: str, regex: bool = False, limit: int = 20, asset_team: str | None = None) -> dict:
        return {"matches": [plain(r) for r in retrieval.grep(self.evidence["pages"], pattern, regex, bounded("grep_evidence", limit), asset_team).collect()]}

    @tool
    def find_evidence_files(self, name_query: str | None = None, asset_team: str | None = None, format_gate: str | None = None, limit: int = 25) -> dict:
        if format_gate not in (None, "pdf", "text", "image"):
            raise ValueError(f"unknown format {format_gate!r}")
        return {"documents": [plain(r) for r in retrieval.find_documents(self.evidence["documents"], name_query, asset_team, format_gate, bounded("find_evidence_files", limit)).collect()]}

    @tool
    def read_evidence(self, page_id: str | None = None, doc_id: str | None = None, question: str | None = None) -> dict:
        """A page, or all pages of a document; a question about a page goes to the injected vision model with its screenshot."""
        if (page_id is None) == (doc_id is None):
            raise ValueError("give either page_id or doc_id")
        columns = (*retrieval.HIT, "text", "width", "height", "has_screenshot")
        # a store finds the files of a key by its index
        rows = lambda name: self.store.rows_with(name, *(("doc_id", doc_id) if doc_id is not None else ("page_id", page_id))) if self.store is not None else self.evidence.get(name)
        if doc_id is not None:
            pages = [plain(r) for r in retrieval.get_document_pages(rows("pages"), doc_id).select(*columns).collect()]
            return {"doc_id": doc_id, "pages": pages} if pages else {"error": f"no document {doc_id!r}: search_evidence gives ids"}
        row = retrieval.get_page(rows("pages"), page_id, rows("screenshots") if question else None).first()
        if row is None:
            return {"error": f"no page {page_id!r}: search_evidence gives ids"}
        out = {c: row[c] for c in columns}
        if question and self.vision and row["screenshot"] is not None:
            out |= {"finding": self.vision(question, bytes(row["screenshot"])), "citation": {"s3key": row["s3key"], "page": row["page_num"]}}
        return out

    @tool
    def check_document_status(self, name_query: str | None = None, asset_team: str | None = None, status: str | None = None, limit: int = 25) -> dict:
        if status not in (None, *retrieval.STATUSES):
            raise ValueError(f"unknown status {status!r}")
        r = retrieval.document_status(self.evidence["ledger"], name_query, asset_team, status, bounded("check_document_status", limit)).first()
        return {"matches": plain(r.matches), "summary": {s: r[s] for s in retrieval.STATUSES}, "total_matches": r.total_matches, "ledger_as_of": r.ledger_as_of}
