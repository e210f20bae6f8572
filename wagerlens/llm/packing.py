"""Best-fit packing (operator 10) under conflicts of source and duplicate cluster.

Documents are cut into pieces of at most ``capacity`` units; full pieces fill a bin each. The others are dealt by a hash of their id
(rows of an id that fills a good part of a block, and rows without one, by their place)
into blocks of about ``BLOCK`` pieces, and each block is packed by itself, so that work grows with the pieces and no task holds
more than a block. Within a block pieces go from the largest down. Open bins are kept ordered by residual;
the first bin whose residual is large enough is the tightest, and the search goes on to its
successors until one is compatible. Every bin carries one bitmap of the sources and one of the duplicate
clusters that it holds; a bin is compatible if it has neither the piece's source nor its cluster.

Defined cases: null and empty texts have size 0 and get a row without a bin; a null source is a source of its own;
a null cluster conflicts with nothing; pieces of one document conflict with each other; ties go by id and
piece; repeated rows are pieces of their own in one cluster; a row without id is packed like any other; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wagerlens.llm.common import ship, small_enough, table, texts, written
from wagerlens.llm.ngram_join import classes_and_components

CAPACITY, BLOCK = 1024, 4096
#: Rows of one id from which on they are spread by place.
REPEATED = 64


def best_fit(items: list[tuple[int, int | None, int | None]], capacity: int) -> list[int]:
    """The bin of each (size, source, cluster), taken in the given order; bins are numbered as they open."""
    source_bit: dict[int | None, int] = {}
    cluster_bit: dict[int, int] = {}
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ordered
    sources: list[int] = []
    clusters: list[int] = []
    found = []
    for size, source, cluster in items:
        bit = 1 << source_bit.setdefault(source, len(source_bit))
        group = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        place = bisect_left(open_bins, (size, -1))
        while place < len(open_bins):
            number = open_bins[place][1]
            if not (sources[number] & bit or clusters[number] & group):
                break
            place += 1
        if place < len(open_bins):
            residual, number = open_bins.pop(place)
        else:
            residual, number = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[number] |= bit
        clusters[number] |= group
        if residual > size:
            insort(open_bins, (residual - size, number))
        found.append(number)
    return found


def pack(sized: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pack a frame of doc_id, size, source, cluster.

    Returns doc_id, piece, start, size (of the piece), source, cluster, block, part, bin and bin_size. A bin is named by block, part
    and bin: part 0 holds packed pieces, further parts full ones.
    """
    kind = sized.schema["doc_id"].dataType.simpleString()
    sized = written(sized.select("doc_id", "size", "source", "cluster"))  # the rows' places must not change from here on
    blocks = max(1, -(-sized.count() // block))
    often = sized.filter("doc_id is not null").groupBy("doc_id").count().filter(f"count >= {REPEATED}").select("doc_id", F.lit(True).alias("often"))
    placed = sized.withColumn("place", F.monotonically_increasing_id()).join(small_enough(written(often)), "doc_id", "left")
    spread = F.when(F.col("doc_id").isNull() | F.col("often"), F.col("place"))
    cut = placed.select(
        "doc_id", F.coalesce("size", F.lit(0)).cast("long").alias("total"), F.xxhash64("source").alias("source_hash"), "source", F.col("cluster").cast("long").alias("cluster"),
        F.pmod(F.xxhash64(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), spread), F.lit(blocks)).alias("block"),
    )
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / capacity).cast("long"))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    cut = cut.withColumn("start", F.col("piece") * capacity).withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("start")))
    # The full pieces of very long documents are dealt on, a few of each document to a part.
    cut = cut.withColumn("part", F.when(F.col("size") < capacity, F.lit(0).cast("long")).otherwise(1 + F.floor(F.col("piece") / 8).cast("long")))
    columns = ("doc_id", "piece", "start", "size", "source", "cluster", "block", "part")

    def packed(group: pa.Table) -> pa.Table:
        order = group.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = order["size"].to_pylist()
        some = sum(size > 0 for size in sizes)
        items = zip(sizes[:some], order["source_hash"].to_pylist(), order["cluster"].to_pylist())
        bins = best_fit(list(items), capacity)
        filled = [0] * (max(bins, default=-1) + 1)
        for size, place in zip(sizes, bins):
            filled[place] += size
        nothing = [None] * (len(sizes) - some)
        order = order.select(columns).append_column("bin", pa.array(bins + nothing, pa.int64()))
        return order.append_column("bin_size", pa.array([filled[place] for place in bins] + nothing, pa.int64()))

    types = f"doc_id {kind}, piece long, start long, size long, source string, cluster long, block long, part long, bin long, bin_size long"
    return cut.select(*columns, "source_hash").groupBy("block", "part").applyInArrow(packed, types)


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str | None = "source") -> DataFrame:
    """doc_id, size in words, source, and a cluster: the same for texts of equal words, but for case."""
    kept = texts(docs, id_column, text_column)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").cast("binary").alias("text"), _source(docs, source_column))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, clusters = [], []
            for text in batch["text"]:  # one text's words at a time
                words = (text.as_py() or b"").lower().split()
                sizes.append(len(words))
                clusters.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), batch["source"], pa.array(clusters, pa.int64())], ["doc_id", "size", "source", "cluster"])

    return rows.mapInArrow(sized, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, size long, source string, cluster long")


def _source(docs: DataFrame, source_column: str | None) -> Column:
    return (F.col(f"`{source_column}`").cast("string") if source_column in docs.columns else F.lit(None).cast("string")).alias("source")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``pack`` for documents by their words."""
    return pack(measured(docs), capacity, block)


def pack_near_copies(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``pack_documents`` for documents not yet rid of near copies: a cluster is a component of the n-gram Jaccard join.

    Sizes come from the join's first pass over the texts. The join knows a row by its text, so that rows without an id take part.
    """
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64(text).alias("doc_id"), text.cast("binary").alias("text"), F.col("doc_id").alias("given_id"), _source(docs, "source"))
    found = classes_and_components(rows, keep=("given_id", "source"))
    return pack(found.select(F.col("given_id").alias("doc_id"), F.col("n_words").alias("size"), "source", F.col("component").alias("cluster")), capacity, block)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of all documents."""
    return pack_near_copies(table(spark, sf_dir, "documents"))
