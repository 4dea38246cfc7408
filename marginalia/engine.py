"""One object for all operations of a bundle, and calls by name with loose arguments."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.bundle import Bundle, canonical_tags, from_testdata
from marginalia.functions import columns as C
from marginalia.operators import access, adopt, grep, lint, meta, sample, vectors
from marginalia.operators import query as Q
from marginalia.operators.scope import EVERYTHING, Scope
from marginalia.operators.sqlgate import Gate
from marginalia.operators.sync import State
from marginalia.sources import files
from marginalia.tables import cut_lineage


class Engine:
    """Reads over a bundle.  `reload` gives the bundle anew; it is called again when it is older than
    `ttl` seconds."""

    def __init__(self, bundle: Bundle, embedder: vectors.Embedder | None = None, reload: Callable[[], Bundle] | None = None, ttl: float = 2.0, sources: dict[str, str] | None = None, state: State | None = None):
        self.bundle, self.embedder, self._reload, self._ttl, self._at = bundle, embedder or vectors.LetterEmbedder(), reload, ttl, time.time()
        self._sources, self._labels, self._state, self._meta = sources, None, state, None
        self._chunks: DataFrame | None = None  # the chunks of the bundle with the identities of their embeddings
        self._cache: DataFrame | None = None  # embeddings by identity

    @classmethod
    def open_testdata(cls, spark: SparkSession, folder: str) -> Engine:
        """Tables that don't change; the rows in force and their tags are worked out once and kept."""
        b = from_testdata(spark, folder)
        return cls(replace(b, docs=cut_lineage(b.docs), tags=cut_lineage(b.tags)))

    @classmethod
    def open_folder(cls, spark: SparkSession, root: str, vocabulary: DataFrame | None = None, state: State | None = None, embedder: vectors.Embedder | None = None) -> Engine:
        """A folder's documents and tables.  With a state only files that changed are read again, and embeddings are kept;
        tables are read again where their files changed.  The vocabulary is the folder's own if none is given."""
        engine = cls.__new__(cls)
        data: dict = {"version": None}

        def load() -> Bundle:
            if state is not None:
                files.sync_folder(spark, root, state)
                d = state.read("docs")
            else:
                d = cut_lineage(files.documents(files.read_markdown(spark, root)))
            if (version := files.data_version(root)) != data["version"]:
                tables, sources, labels, _ = files.datasets(spark, root)
                data.update(version=version, tables=tables)
                engine._sources, engine._labels = sources, labels
            tags = d.select(F.col("id").alias("doc_id"), F.posexplode("tags").alias("ord", "tag")).withColumn("norm", C.normalize_tag(F.col("tag")))
            tags = tags.withColumn("folded", C.fold(F.col("norm")))
            engine._meta = meta.read(d)
            names = vocabulary if vocabulary is not None else meta.vocabulary(spark, engine._meta)
            return Bundle(d.drop("tags"), canonical_tags(tags, names), names, data["tables"])

        bundle = load()
        sources, labels, own = engine._sources, engine._labels, engine._meta
        engine.__init__(bundle, embedder, reload=load, sources=sources, state=state)
        engine._labels, engine._meta = labels, own
        return engine

    def refresh(self) -> None:
        if self._reload and time.time() - self._at > self._ttl:
            self.bundle, self._at = self._reload(), time.time()
            self._chunks = None

    # -- reads -------------------------------------------------------------------------------------

    def query(self, scope: Scope = EVERYTHING, **args) -> dict:
        return Q.run(self.bundle, Q.request_of(args), scope)

    def grep(self, pattern: str, scope: Scope = EVERYTHING, filter: dict | None = None, **args) -> dict:
        return grep.run(self.bundle, pattern, f=Q.request_of(filter) if filter else None, scope=scope, **args)

    def get(self, id: str, scope: Scope = EVERYTHING, **args) -> dict:
        return access.get(self.bundle, id, scope=scope, **args)

    #: Rows of a listing that a call shows.
    SHOWN = 5000

    def list(self, dir: str = ".", scope: Scope = EVERYTHING) -> dict:
        """The folder's index document if nothing is hidden, else a listing."""
        key = dir.strip("./")
        index = None if scope.restricted else self.bundle.docs.filter(F.col("id") == (f"{key}/index" if key else "index")).first()
        if index is not None:
            return {"dir": dir, "source": "index.md", "content": index["body"]}
        rows = access.list_dir(self.bundle, dir, scope).orderBy("kind", "name").limit(self.SHOWN + 1).collect()
        more, rows = len(rows) > self.SHOWN, rows[: self.SHOWN]
        return {"dir": dir, "source": "generated", "truncated": more, "content": "\n".join(f"- {r['name']}/ ({r['documents']})" if r["kind"] == "dir" else f"- {r['name']}: {r['title'] or ''}" for r in rows)}

    def catalog(self, max_tokens: int = access.CATALOG_TOKENS, scope: Scope = EVERYTHING) -> dict:
        return access.catalog(self.bundle, max_tokens, scope)

    def links(self, id: str, scope: Scope = EVERYTHING) -> dict:
        seen = Q.visible(self.bundle, scope).select("id")
        if not seen.filter(F.col("id") == id).head(1):
            raise access.NotFound(id)
        links = access.resolve_wiki(self.bundle.links(), self.bundle.docs.select("id"))
        links = links.filter(F.col("target").isNull() | scope.path(F.coalesce("target", F.lit(""))))
        out, back = access.outgoing(links, self.bundle.docs, id).orderBy("line").limit(self.SHOWN + 1).collect(), access.backlinks(links, seen, id).orderBy("src", "line").limit(self.SHOWN + 1).collect()
        return {"id": id, "outgoing": [r.asDict() for r in out[: self.SHOWN]], "backlinks": [r.asDict() for r in back[: self.SHOWN]], "truncated": max(len(out), len(back)) > self.SHOWN}

    def graph(self, limit: int = 2000, scope: Scope = EVERYTHING, filter: dict | None = None) -> dict:
        return access.graph(self.bundle, Q.request_of(filter) if filter else None, limit, scope)

    def stats(self, scope: Scope = EVERYTHING) -> dict:
        return access.stats(self.bundle, scope)

    def lint(self, target: int = 2, disabled: tuple[str, ...] = (), max_doc_tokens: int = 8000, limit: int = 10_000) -> dict:
        """The counts of all findings, and the first `limit` of them."""
        d = lint.lint(meta.context(self.bundle, self._meta, max_doc_tokens=max_doc_tokens, disabled=frozenset(disabled))).filter(F.col("level") <= target).persist()
        try:
            s = lint.summary(d, target).first()
            rows = [r.asDict() for r in d.orderBy("path", "line", "rule", "message").limit(limit).collect()]
        finally:
            d.unpersist()
        return {"target": target, "level": s["level"], "errors": s["errors"], "warnings": s["warnings"], "diagnostics": rows, "more": s["errors"] + s["warnings"] - len(rows)}

    def vocabulary(self) -> list[dict]:
        """The most used groups of tags; `adopt.tag_groups` has all of them."""
        return [r.asDict() for r in adopt.tag_groups(self.bundle.tags).orderBy(F.desc("documents"), "tag").limit(self.SHOWN).collect()]

    # -- tables ------------------------------------------------------------------------------------

    def _gate(self) -> Gate:
        return Gate(self.bundle.datasets, self._sources, self._labels)

    def data_tables(self, scope: Scope = EVERYTHING) -> list[dict]:
        return self._gate().tables(scope)

    def data_query(self, sql: str, max_rows: int = 100, timeout: float = 5.0, scope: Scope = EVERYTHING) -> dict:
        return self._gate().query(sql, max_rows, timeout, scope)

    # -- vectors -----------------------------------------------------------------------------------

    def embed(self, most: int | None = None) -> int:
        """Embeds the chunks that have no embedding yet (with `most` at most so many), and returns how many that were.
        Embeddings are kept by identity: what was embedded once isn't again, whatever document it is in."""
        if self._chunks is None:
            titled = self.bundle.chunks().join(self.bundle.docs.select(F.col("id").alias("doc_id"), "title"), "doc_id")
            self._chunks = cut_lineage(vectors.keyed(titled, self.embedder))
        if self._cache is None and self._state is not None:
            self._cache = self._state.read("vectors")
        fresh = cut_lineage(vectors.fill_cache(self._chunks, self._cache, self.embedder, most))
        n = fresh.count()
        if n or self._cache is None:
            self._cache = fresh if self._cache is None else self._cache.unionByName(fresh)
            if self._state is not None:
                self._state.commit({"vectors": self._cache})
                self._cache = self._state.read("vectors")
        return n

    #: The most chunks that a search embeds on its way.
    TOP_UP = 64

    def search(self, query: str, limit: int = 8, per_doc: int = 2, scope: Scope = EVERYTHING) -> dict:
        self.embed(self.TOP_UP if self._cache is not None else None)
        seen = self._chunks.join(Q.visible(self.bundle, scope).select(F.col("id").alias("doc_id")), "doc_id", "left_semi") if scope.restricted else self._chunks
        v = seen.select(F.col("id").alias("chunk_id"), "doc_id", "key").join(self._cache, "key")
        q = self.bundle.spark.createDataFrame([(0, [float(x) for x in self.embedder.queries([query])[0]])], "query_id bigint, qvec array<float>")
        best = {h["chunk_id"]: h for h in vectors.search(v, q, limit, per_doc).collect()}  # at most 50
        texts = {r["id"]: r for r in seen.filter(F.col("id").isin(list(best))).select("id", "heading", "text", "tokens").collect()} if best else {}
        hits = sorted(best.values(), key=lambda h: h["rank"])
        return {"model": self.embedder.model, "hits": [{"id": h["doc_id"], "heading": (t := texts[h["chunk_id"]])["heading"], "score": h["score"], "text": t["text"], "tokens": t["tokens"], "chunk_id": h["chunk_id"]} for h in hits]}

    def retrieve(self, query: str, budget: int = 3000, scope: Scope = EVERYTHING) -> dict:
        found = self.search(query, 12, 2, scope)
        used, kept = 0, []
        for h in found["hits"]:
            if not kept or used + h["tokens"] <= budget:
                kept.append(h)
                used += h["tokens"]
        return {"model": found["model"], "hits": kept, "tokens": used}

    # -- training data -----------------------------------------------------------------------------

    def tune_plan(self, scope: Scope = EVERYTHING, settings: sample.Settings = sample.Settings()) -> dict:  # noqa: B008: frozen
        chunks = self.bundle.chunks().join(Q.visible(self.bundle, scope).select(F.col("id").alias("doc_id"), "lang", "title"), "doc_id")
        p = sample.stratified(chunks, settings).persist()
        try:
            held = sample.heldout(p.select("doc_id"), settings)
            return {"passages": p.count(), "heldout": sorted(r["doc_id"] for r in held.filter("heldout").collect()), "batches": [tuple(r) for r in sample.batches(p.select("turn", "key", "tokens"), settings).collect()]}
        finally:
            p.unpersist()

    def replay(self, cases: list[dict]) -> DataFrame:
        """id, category, passed and baseline_passed of recorded cases: {id, cat, calls: [{tool, args}],
        expect: {ids, values, rank}, baseline}.  A call that fails fails its case."""
        rows = []
        for c in cases:
            found, text, ok = [], [], True
            for call in c["calls"]:
                try:
                    r = self.call(call["tool"], call.get("args"))
                except Exception:  # noqa: BLE001: any error is a failed case
                    ok = False
                    break
                text.append(str(r))
                found += [d["id"] for d in r.get("docs", r.get("hits", []))] if isinstance(r, dict) else []
            rows.append((c["id"], c.get("cat", ""), ok and sample.judge_case(c.get("expect", {}), found, "\n".join(text)), c.get("baseline") == "pass"))
        return self.bundle.spark.createDataFrame(rows, "id string, category string, passed boolean, baseline_passed boolean")

    # -- calls by name -----------------------------------------------------------------------------

    TOOLS = ("search", "retrieve", "catalog", "list", "grep", "get", "query", "data_tables", "data_query", "links", "graph", "stats", "lint", "vocabulary")

    def call(self, name: str, args: dict | None = None, scope: Scope = EVERYTHING):
        """A tool by name; refreshes first.  Rules and the vocabulary report see everything."""
        if name not in self.TOOLS:
            raise access.InvalidArgument(f"no tool {name}")
        self.refresh()
        if name in ("lint", "vocabulary"):
            return getattr(self, name)(**(args or {}))
        return getattr(self, name)(**(args or {}), scope=scope)
