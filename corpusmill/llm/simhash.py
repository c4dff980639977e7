"""SimHash near-duplicates, found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.common import bounded_batches, connected_components, stage, words_of

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLOCK = 1 << 16


def bit_majority(hashes: Iterator[int]) -> int:
    """Signed 64-bit number whose bits are set where over half of the hashes have them; zero without hashes."""
    ones, total = np.zeros(64, np.int64), 0
    while len(block := np.fromiter(islice(hashes, BLOCK), dtype="<u8")):
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def text_fingerprint(text: bytes, words: int) -> int:
    """Fingerprint of one UTF-8 text; shingles are hashed in blocks, so memory stays bounded for very long texts."""
    from xxhash import xxh64_intdigest

    found = text.translate(LOWER).split()  # bytes are split at exactly the white space of the contract
    if not found:
        return 0
    if len(found) < words:
        return bit_majority(iter([xxh64_intdigest(b" ".join(found), 42)]))
    shingles = map(b" ".join, zip(*(islice(found, k, None) for k in range(words))))
    return bit_majority(map(xxh64_intdigest, shingles, repeat(42)))


def native_fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint of `text_fingerprint` as a SQL expression. Long j of a chunk of 126 hashes counts the bits j, j + 8, ... in
    its eight bytes, which 126 cannot overflow."""
    chunk, lanes = 126, F.lit(0x0101010101010101)

    def bind(value: Column, build) -> Column:
        return F.transform(F.array(value), build)[0]

    def hashes(w: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        shingle = lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + k) for k in range(words))))
        return F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(0), F.size(w) - words), shingle)).otherwise(F.when(F.size(w) > 0, whole))

    def counted(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(h) - 1) / chunk).cast("int"))
        part = lambda i: F.slice(h, i * chunk + 1, F.lit(chunk))
        add = lambda j: lambda a, x: a + F.shiftrightunsigned(x, j).bitwiseAND(lanes)
        count = lambda p: F.array(*(F.aggregate(p, F.lit(0).cast("long"), add(j)) for j in range(8)))
        return F.transform(starts, lambda i: bind(part(i), count))

    def majority(h: Column) -> Column:
        def bits(c: Column) -> Column:
            ones = lambda p: F.aggregate(c, F.lit(0), lambda a, x: a + F.shiftrightunsigned(F.get(x, F.lit(p % 8)), 8 * (p // 8)).bitwiseAND(F.lit(255)).cast("int"))
            set_bits = [F.when(2 * ones(p) > F.size(h), F.lit(signed(1 << p))).otherwise(F.lit(0).cast("long")) for p in range(64)]
            while len(set_bits) > 1:
                set_bits = [a.bitwiseOR(b) for a, b in zip(set_bits[::2], set_bits[1::2])]
            return set_bits[0]

        return bind(counted(h), bits)

    upper, lower = (bytes(range(k, k + 26)).decode() for k in (65, 97))
    return F.coalesce(bind(bind(words_of(F.translate(text, upper, lower)), hashes), majority), F.lit(0).cast("long"))


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 3) -> DataFrame:
    """(id, digest, fingerprint) per row, without a shuffle. The digest tells rows with equal or null ids apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_fingerprint(x.as_py() or b"", words) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], names=["id", "digest", "fingerprint"])

    bounded_batches()
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("digest"), F.col(text).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "id long, digest long, fingerprint long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 bit masks (Pagh, CoveringLSH, 2016). Bit i carries a vector m(i) of radius + 1 bits that is not zero; mask v keeps
    the bits with an odd product <m(i), v>. Up to `radius` vectors span less than the whole space, so some v is
    orthogonal to all of them, and two values that differ in those bits agree under that mask: no pair is missed."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, 2 ** (radius + 1))]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def fingerprint_links(nodes: DataFrame, radius: int = 3, full_bucket: int = 256) -> DataFrame:
    """Links (a, b) between distinct fingerprints, complete up to connectivity: two fingerprints are connected by links if and only if
    they are connected by pairs of `radius` or fewer differing bits.

    Every fingerprint goes to one bucket per covering mask. In buckets of up to `full_bucket` values the pairs are compared directly.
    Values of fuller buckets are linked exactly without comparing pairs: x and y differ in at most `radius` bits if and only
    if some value z lies within `radius // 2` bits of one and within the other half of the other. All values around a z
    link to the smallest value in its inner ring. That is linear in the number of values, and no z gathers
    more values than there are bit patterns, so dense balls cost no square.
    """
    masks = [signed(m) for m in covering_masks(radius)]
    keys = F.array(*(F.struct(F.lit(i).cast("byte").alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    entries = nodes.select("fingerprint", F.explode(keys).alias("k")).select("k.t", "k.key", "fingerprint")
    # Staged, since the optimizer takes the entries for as small as the table of nodes and would have the driver broadcast them.
    entries = stage(entries, "entries")
    shared = entries.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = stage(entries.join(shared, ["t", "key"]), "buckets")
    few, many = members.where(F.col("n") <= full_bucket), members.where(F.col("n") > full_bucket).select("fingerprint").distinct()
    left, right = few.select("t", "key", F.col("fingerprint").alias("a")), few.select("t", "key", F.col("fingerprint").alias("b"))
    compared = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & near("a", "b", radius)).select("a", "b")
    inner, outer = radius // 2, radius - radius // 2
    patterns = [signed(sum(1 << i for i in chosen)) for r in range(outer + 1) for chosen in combinations(range(64), r)]

    def around(reach: int, name: str) -> DataFrame:
        fit = [p for p in patterns if bin(p & (2**64 - 1)).count("1") <= reach]
        return many.select(F.col("fingerprint").alias(name), F.explode(F.lit(fit)).alias("p")).select(name, F.col(name).bitwiseXOR(F.col("p")).alias("z"))

    centres = around(inner, "b").groupBy("z").agg(F.min("b").alias("b"))
    # The optimizer takes the rows around a value for as small as the value alone and would have the driver broadcast them.
    dense = around(outer, "a").join(centres.hint("merge"), "z").where("a <> b").select("a", "b").distinct()
    return compared.distinct().union(dense)


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 3, radius: int = 3, full_bucket: int = 256, salts: int = 16) -> DataFrame:
    """One row (id, digest, fingerprint, label, component_id) per row of `docs`; component_id is the smallest id whose fingerprint can
    be reached over links of `radius` or fewer differing bits, label is a fingerprint that names the component.

    Equal fingerprints are one node, so copies never meet as pairs. Null and empty texts have fingerprint zero and are
    linked like any other; repeated rows each give a row; a null id names no component unless all ids in it are null;
    an empty table gives no rows; other columns of `docs` are not read.
    """
    rows = stage(fingerprints(docs, text, id_column, words), "fingerprints")
    nodes = stage(rows.groupBy("fingerprint").agg(F.min("id").alias("first")), "nodes")
    labels = stage(connected_components(fingerprint_links(nodes, radius, full_bucket)), "labels")
    linked = nodes.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    lowest = linked.where("label is not null").groupBy("label").agg(F.min("first").alias("lowest"))
    component = F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("lowest")).alias("component_id")
    # The label of a large component is a hot key: its members are salted, its one row is repeated for each salt.
    lowest = lowest.select("label", "lowest", F.explode(F.lit(list(range(salts)))).alias("salt"))
    linked = linked.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)).cast("int"))
    named = stage(linked.join(lowest, ["label", "salt"], "left").select("fingerprint", F.coalesce("label", "fingerprint").alias("label"), component), "components")
    return rows.join(named, "fingerprint").select("id", "digest", "fingerprint", "label", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 3, radius: int = 3) -> DataFrame:
    """The rows of `docs` that stay when one row of each component does: the one with the smallest id (null ids last, then the smallest
    digest of the text). Of rows with the same id and text the first by their JSON form stays."""
    found = near_duplicates(docs, text, id_column, words, radius)
    order = F.struct(F.col("id").isNull().alias("nameless"), F.col("id").alias("id"), F.col("digest").alias("digest"))
    best = found.groupBy("label").agg(F.min(order).alias("best")).select(F.col("best.id").alias("_id"), F.col("best.digest").alias("_digest"))
    copies = found.groupBy(F.col("id").alias("_i"), F.col("digest").alias("_d")).agg(F.count("*").alias("_copies"))
    best = stage(best.join(copies, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d"))).select("_id", "_digest", "_copies"), "kept")
    same = docs[id_column].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text]) == F.col("_digest"))
    once = docs.join(best.where("_copies = 1"), same, "left_semi")
    repeated = docs.join(best.where("_copies > 1"), same)
    row = F.struct(*(docs[c] for c in docs.columns))
    picked = repeated.groupBy("_id", "_digest").agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*")
    return once.unionByName(picked)
