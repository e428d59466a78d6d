"""Receipts, capsules, signed manifests and history chains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import integrity as I
from ..storage import materialize

ALG = "ecdsa-p256-sha256"
#: Rows whose leaves make one subtree: a power of two.
SUBTREE = 1 << 12


def canonical_json(**fields: Column) -> Column:
    """A struct as JSON: fields in the order given, nulls left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def capsule(payload: Column, scheme: str = "page") -> Column:
    return F.concat(F.lit(scheme + ":"), I.base64url(payload.cast("binary")))


def open_capsule(text: Column, scheme: str = "page") -> Column:
    """The payload; null for anything else."""
    body = F.regexp_extract(text, f"^{scheme}:([A-Za-z0-9_-]+)$", 1)
    return F.when(body != "", I.from_base64url(body).cast("string"))


def ordered_root(df: DataFrame, order: list[str], leaf: str) -> str | None:
    """Merkle root of all rows' leaves in order, without any task that holds them all.

    Rows are ranged into parts, numbered by part and place, and cut into subtrees of ``SUBTREE`` leaves; one small
    hash each is left, and their tree is taken the same way. Ids of ``order`` should be unique: they are the order.
    """
    ranged = materialize(
        df.select(*order, F.col(leaf).alias("__leaf")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "leaves"
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    numbered = ranged.join(F.broadcast(sizes), "__part").withColumn(
        "__i", F.col("__base") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    )
    level = numbered.select("__i", "__leaf")
    total = ranged.count()
    while total > 1:
        last = (total - 1) // SUBTREE
        height = min(int(math.log2(SUBTREE)), math.ceil(math.log2(total)))
        nodes = level.groupBy(F.floor(F.col("__i") / SUBTREE).alias("__i")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("__i", "__leaf"))), lambda s: s["__leaf"]).alias("nodes")
        )
        level = nodes.select("__i", F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.col("nodes"), lambda a, _: I.parent_level(a))[0].alias("__leaf"))
        total = last + 1
    row = level.select("__leaf").first()
    return row["__leaf"] if row else None


def numbered_within(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``df`` with ``__i``, a row's place in its group from 0, and ``__total``, the group's rows.

    As in :func:`ordered_root`: parts are ranges over group and order, so that no task holds a large group.
    """
    ranged = materialize(df.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(by, "__part").agg(F.count("*").alias("__n"))  # one row a part and group
    group = Window.partitionBy(by)
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col(by).alias("__by"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(group).alias("__total")
    )
    place = F.row_number().over(Window.partitionBy("__part", by).orderBy(*order))
    joined = ranged.withColumn("__k", place).join(sizes, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn("__i", F.col("__base") + F.col("__k") - 1).drop("__by", "__p", "__part", "__k", "__base")


def ordered_roots(df: DataFrame, by: str, order: list[str], leaf: str) -> DataFrame:
    """(by, root): the Merkle root of each group's leaves in order, by subtrees of ``SUBTREE`` leaves."""
    level = materialize(numbered_within(df.select(by, *order, F.col(leaf).alias("__leaf")), by, order).select(by, "__i", "__total", "__leaf"), "leaves")
    most = level.agg(F.max("__total")).first()[0] or 0
    while most > 1:
        nodes = level.groupBy(by, F.floor(F.col("__i") / SUBTREE).alias("__i"), "__total").agg(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), "__leaf"))), lambda s: s["__leaf"]).alias("nodes")
        )
        height = F.least(F.lit(int(math.log2(SUBTREE))), F.length(F.bin(F.col("__total") - 1)))
        top = F.aggregate(F.sequence(F.lit(1), height), F.col("nodes"), lambda a, _: I.parent_level(a))[0]
        level = nodes.select(
            by, "__i", F.ceil(F.col("__total") / SUBTREE).alias("__total"), F.when(F.col("__total") > 1, top).otherwise(F.col("nodes")[0]).alias("__leaf")
        )
        most = -(-most // SUBTREE)
    return level.select(by, F.col("__leaf").alias("root"))


def manifest(spark: SparkSession, created_at: str, rows: int, root: str | None, key_id: str) -> str:
    """Canonical text of a data set's manifest."""
    fields = {"v": F.lit(1), "createdAt": F.lit(created_at), "rowCount": F.lit(rows), "manifestRoot": F.lit(root).cast("string"), "keyId": F.lit(key_id), "alg": F.lit(ALG)}
    return spark.range(1).select(canonical_json(**fields).alias("m")).first()["m"]


class Signer:
    """ECDSA over P-256 in the driver's JVM: for one manifest, not for rows."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        maker = self.jvm.java.security.KeyPairGenerator.getInstance("EC")
        maker.initialize(self.jvm.java.security.spec.ECGenParameterSpec("secp256r1"))
        self.pair = maker.generateKeyPair()

    def key_id(self) -> str:
        import hashlib

        kind = self.jvm.java.lang.Class.forName("java.security.spec.X509EncodedKeySpec")
        spec = self.jvm.java.security.KeyFactory.getInstance("EC").getKeySpec(self.pair.getPublic(), kind)
        return hashlib.sha256(bytes(spec.getEncoded())).hexdigest()[:16]

    def _engine(self):
        return self.jvm.java.security.Signature.getInstance("SHA256withECDSAinP1363Format")

    def sign(self, text: str) -> bytes:
        engine = self._engine()
        engine.initSign(self.pair.getPrivate())
        engine.update(bytearray(text.encode()))
        return bytes(engine.sign())

    def verify(self, text: str, signature: bytes) -> bool:
        engine = self._engine()
        engine.initVerify(self.pair.getPublic())
        engine.update(bytearray(text.encode()))
        return engine.verify(bytearray(signature))


def receipt_status(text: Column, receipt_hash: Column, key_id: Column, known_key: str, signature_ok: Column) -> Column:
    """First thing that is wrong with a receipt, or ``verified``."""
    return (
        F.when(receipt_hash.isNull() | key_id.isNull(), "invalid_receipt").when(key_id != known_key, "wrong_key")
        .when(~signature_ok, "signature_invalid").when(~I.same_hash(receipt_hash, I.content_hash(text)), "content_mismatch").otherwise("verified")
    )


def history_chain(visits: Column) -> Column:
    """Entries of one watched page: a fold over its sorted (ts, hash) visits that appends on the first and on changes.

    Each entry holds the hash of the one before, so this cannot be cut up; it is row-local and holds one page's visits.
    """
    entry = "array<struct<seq: int, event: string, hash: string, prev: string, digest: string>>"

    def step(acc, v):
        last = F.try_element_at(acc, F.lit(-1))
        same = last.isNotNull() & (last["hash"] == v["hash"])
        seq, event = F.size(acc), F.when(last.isNull(), "first_seen").otherwise("changed")
        prev = last["digest"]
        digest = F.sha2(F.concat_ws("\n", seq.cast("string"), v["ts"].cast("string"), event, v["hash"], F.coalesce(prev, F.lit(""))), 256)
        new = F.struct(seq.alias("seq"), event.alias("event"), v["hash"].alias("hash"), prev.alias("prev"), digest.alias("digest"))
        return F.when(same, acc).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(visits, F.array().cast(entry), step)


def chain_intact(entries: Column) -> Column:
    """Sequence without gaps and every entry pointing at the one before; a window of a chain may start late."""
    ok = F.transform(
        entries,
        lambda e, i: (i == 0) | ((e["seq"] == entries[i - 1]["seq"] + 1) & (e["prev"] == entries[i - 1]["digest"])),
    )
    return F.forall(ok, lambda x: x)
