"""A bundle: the tables of a knowledge collection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import columns as C
from marginalia.functions import fields as metadata
from marginalia.functions import markdown as M
from marginalia.functions.fields import EXTRA
from marginalia.tables import current_rows, spread, table

DOC_COLUMNS = ("id", "path", "type", "title", "description", "lang", "status", "updated", *EXTRA, "reserved", "fm_state", "tokens")


class Tables(Mapping):
    """Tables of a folder by name, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...]):
        self._spark, self._folder, self._names, self._read = spark, folder, names, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._read:
            self._read[name] = table(self._spark, self._folder, name)
        return self._read[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


@dataclass
class Bundle:
    """docs (with body), tags (doc_id, ord, tag, norm, folded, canonical), vocabulary (tag, synonyms, facet,
    description), datasets by name, and a reader of vectors (chunk_id, doc_id, vec)."""

    docs: DataFrame
    tags: DataFrame
    vocabulary: DataFrame
    datasets: Mapping[str, DataFrame] = field(default_factory=dict)
    read_vectors: Callable[[], DataFrame] | None = None

    @property
    def vectors(self) -> DataFrame | None:
        return self.read_vectors() if self.read_vectors else None

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def fields(self) -> DataFrame:
        """doc_id, key, idx, value_type, value_text, value_num of every metadata field that isn't null."""
        return metadata.long_table(self.docs)

    def chunks(self) -> DataFrame:
        """id (of document and number), doc_id, ord, heading, text, start_line, end_line, tokens; reserved
        documents and empty bodies have none."""

        def cut(batches):
            import pandas as pd

            for pdf in batches:
                rows = [(k, c.ord, c.heading, c.text, c.start_line, c.end_line, c.tokens) for k, b in zip(pdf["id"], pdf["body"]) for c in M.chunks(b)]
                yield pd.DataFrame(rows, columns=["doc_id", "ord", "heading", "text", "start_line", "end_line", "tokens"])

        got = self.docs.filter(~F.coalesce("reserved", F.lit(False))).select("id", "body").filter("body is not null")
        got = spread(got).mapInPandas(cut, "doc_id string, ord int, heading string, text string, start_line int, end_line int, tokens int")
        return got.withColumn("id", F.xxhash64("doc_id", "ord"))

    def links(self) -> DataFrame:
        """src, raw, target (null if it leads to no document path), kind, text, line."""

        def find(batches):
            import pandas as pd

            for pdf in batches:
                rows = [(k, raw, M.resolve_link(k, raw) if kind == "markdown" else None, kind, text, line) for k, b in zip(pdf["id"], pdf["body"]) for raw, text, kind, line in M.links(b)]
                yield pd.DataFrame(rows, columns=["src", "raw", "target", "kind", "text", "line"])

        got = self.docs.select("id", "body").filter(F.col("body").contains("]"))
        return got.mapInPandas(find, "src string, raw string, target string, kind string, text string, line int")


def canonical_tags(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tags with the canonical term by normalized name; the vocabulary is small and fixed, and is joined
    by whatever way its size allows."""
    names = vocabulary.select(F.col("tag").alias("term"), F.explode(F.concat(F.array("tag"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    names = names.select("term", C.normalize_tag(F.col("name")).alias("norm")).filter("norm is not null and norm <> ''").groupBy("norm").agg(F.min("term").alias("canonical"))
    return tags.drop("canonical").join(names, "norm", "left")


def from_testdata(spark: SparkSession, folder: str, bodies: bool = True) -> Bundle:
    """The bundle of the driver's tables: the current rows of docs, their tags, and the other tables as
    datasets.  Without `bodies` these are empty texts, so that who only asks whether there is one doesn't move them."""
    docs = table(spark, folder, "docs")
    if not bodies:
        docs = docs.withColumn("text", F.when(F.col("text").isNotNull(), ""))
    docs = current_rows(docs, "id", *[c for c in DOC_COLUMNS if c != "id"], "generated", "text").withColumnRenamed("text", "body")
    # the block as it would stand before the body, and its content as JSON; columns that nobody asks for aren't worked out
    keys = [c for c in DOC_COLUMNS if c in metadata.COLUMNS]
    block = F.concat(F.lit("---\n"), F.concat_ws("", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string"), F.lit("\n")) for c in keys]), F.lit("---\n"))
    docs = docs.withColumn("fm_raw", F.when(F.col("fm_state") == "valid", block).otherwise(""))
    docs = docs.withColumn("frontmatter", F.to_json(F.struct(*keys, F.col("generated.by").alias("generated_by"), F.col("generated.at").alias("generated_at")))).drop("generated")
    tags = table(spark, folder, "doc_tags").select("doc_id", "ord", "tag").distinct().filter(C.blank_to_null(F.col("tag")).isNotNull())
    tags = tags.withColumn("norm", C.normalize_tag(F.col("tag"))).withColumn("folded", C.fold(F.col("norm")))
    vocabulary = table(spark, folder, "terms")
    names = ("sales", "price_list", "inventory", "customer", "orders", "lineitem", "part", "supplier", "nation", "region", "events")

    def vectors() -> DataFrame:
        return table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("doc_id"), F.col("embedding").alias("vec"))

    return Bundle(docs, canonical_tags(tags, vocabulary), vocabulary, Tables(spark, folder, names), vectors)
