"""Hashes, Merkle roots and canonical forms as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import round_even


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(text, F.lit("")), 256))


def canonical_json(text: Column, without: str | None = None) -> Column:
    """An object's JSON without white space, keys in order at every level, top key ``without`` left out; null if it is none.

    Numbers are written by value: 1.50 as 1.5. A key that occurs twice makes it no valid object.
    """
    entries = F.map_entries(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"))
    kept = entries if without is None else F.filter(entries, lambda e: e["key"] != without)
    ordered = F.array_sort(F.transform(kept, lambda e: e["key"]))
    values = F.map_from_entries(kept)
    return F.to_json(F.map_from_arrays(ordered, F.transform(ordered, lambda k: F.element_at(values, k))))


def recipe_hash(text: Column) -> Column:
    """Content hash of a recipe: of its canonical JSON, without what is said about its provenance; null if it is no object."""
    whole = canonical_json(text, "provenance")
    return F.when(whole.isNotNull(), content_hash(whole))


# Names of the two schemes by which recipes are signed, and the algorithm.
RECIPE_V1, RECIPE_V2, RECIPE_ALG = "playbook-sig-v1", "playbook-sig-v2", "ecdsa-p256-sha256"


def recipe_assertion(key_id: Column, recipe: Column, signed_at: Column, score: Column, passes: Column, noise: Column) -> Column:
    """What a signature of the second scheme covers; a null score or noise is left out."""
    fields = F.struct(
        F.lit(RECIPE_ALG).alias("alg"), recipe.alias("contentHash"), key_id.alias("keyId"), signed_at.alias("signedAt"), F.lit(2).alias("v"),
        F.struct(noise.alias("noiseLeakage"), passes.alias("passesGate"), score.alias("score")).alias("verify"),
    )
    return F.concat(F.lit(RECIPE_V2 + "\n"), F.to_json(fields))


def recipe_status(text: Column, local_key: Column, signature_valid: Column) -> Column:
    """(signed, status, key_id, score, passes_gate, version) of a recipe, as ``signature_valid`` says of its signature.

    A recipe whose hash is not that of its content is invalid whatever its signature. What cannot be read is unsigned.
    """
    v = F.try_variant_get(F.try_parse_json(text), "$.provenance", "variant")
    field = lambda path, kind="string": F.try_variant_get(v, path, kind)
    signed = F.coalesce(F.try_variant_get(v, "$.signature", "variant").isNotNull(), F.lit(False))
    scheme, key = field("$.sigScheme"), field("$.keyId")
    version = F.when(scheme.isNull() | (scheme == RECIPE_V1), 1).when(scheme == RECIPE_V2, 2)
    valid = F.coalesce((field("$.contentHash") == recipe_hash(text)) & signature_valid, F.lit(False))
    ours = key.eqNullSafe(local_key)
    status = (
        F.when(~signed, "unsigned").when(version.isNull(), "unsupported_version").when(valid & ours, "verified")
        .when(valid, "key_mismatch").when(ours, "invalid").otherwise("wrong_key")
    )
    of = lambda c: F.when(signed, c)
    return F.struct(
        signed.alias("signed"), status.alias("status"), of(key).alias("key_id"), of(field("$.verify.score", "int")).alias("score"),
        of(field("$.verify.passesGate", "boolean")).alias("passes_gate"), of(version).alias("version"),
    )


def same_hash(a: Column, b: Column) -> Column:
    """Equal as content hashes, with or without prefix, in any case."""

    def bare(x):
        return F.regexp_replace(F.lower(F.trim(x)), "^sha256:", "")

    return bare(a) == bare(b)


def leaf_hash(text: Column, selector: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(text, F.lit("")), F.lit("\0"), F.coalesce(selector, F.lit(""))), 256)


def block_hash(kind: Column, text: Column) -> Column:
    """Short hash of a block's type and text."""
    return F.substring(F.sha2(F.concat(F.coalesce(kind, F.lit("")), F.lit("\x01"), F.coalesce(text, F.lit(""))), 256), 1, 16)


def row_leaf(*fields: Column) -> Column:
    """Leaf of a data set's row: its fields, null as empty, one a line."""
    joined = []
    for f in fields:
        joined += [F.coalesce(f, F.lit("")), F.lit("\n")]
    return F.sha2(F.concat(*joined[:-1]), 256)


def parent_level(nodes: Column) -> Column:
    """The next level of a Merkle tree: pairs hashed, an odd last node with itself. Nodes are hex."""
    pairs = F.sequence(F.lit(1), F.size(nodes), F.lit(2))
    return F.transform(
        pairs,
        lambda i: F.sha2(F.concat(F.unhex(F.element_at(nodes, i)), F.unhex(F.element_at(nodes, F.least(i + 1, F.size(nodes))))), 256),
    )


def merkle_root(leaves: Column) -> Column:
    """Root of hex leaves in order; null without any."""
    levels = F.ceil(F.log2(F.size(leaves))).cast("int")
    steps = F.when(F.size(leaves) > 1, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(leaves) > 0, F.aggregate(steps, leaves, lambda nodes, _: parent_level(nodes))[0])


def merkle_proof(leaves: Column, place: Column) -> Column:
    """Siblings of leaf ``place`` (from 0) from the bottom up: array of (hash, right)."""
    levels = F.ceil(F.log2(F.size(leaves))).cast("int")
    steps = F.when(F.size(leaves) > 1, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    none = F.array().cast("array<struct<hash: string, right: boolean>>")
    start = F.struct(leaves.alias("nodes"), place.cast("int").alias("at"), none.alias("path"))

    def up(acc, _):
        even = acc["at"] % 2 == 0
        sibling = F.when(even, F.least(acc["at"] + 2, F.size(acc["nodes"]))).otherwise(acc["at"])
        step = F.struct(F.element_at(acc["nodes"], sibling).alias("hash"), even.alias("right"))
        return F.struct(
            parent_level(acc["nodes"]).alias("nodes"), F.floor(acc["at"] / 2).cast("int").alias("at"),
            F.concat(acc["path"], F.array(step)).alias("path"),
        )

    return F.aggregate(steps, start, up)["path"]


def verify_proof(leaf: Column, path: Column, root: Column) -> Column:
    def up(node, s):
        pair = F.when(s["right"], F.concat(F.unhex(node), F.unhex(s["hash"]))).otherwise(F.concat(F.unhex(s["hash"]), F.unhex(node)))
        return F.sha2(pair, 256)

    return F.aggregate(path, leaf, up) == root


def base64url(data: Column) -> Column:
    return F.translate(F.regexp_replace(F.base64(data), r"[=\s]", ""), "+/", "-_")


def from_base64url(text: Column) -> Column:
    pad = F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)).cast("int"))
    return F.unbase64(F.concat(F.translate(text, "-_", "+/"), pad))


def drift(present: Column, total: Column) -> Column:
    """Share of cited parts that are gone."""
    return F.when(total > 0, round_even(1 - present / total, 3)).otherwise(0.0)
