"""Tree heads: reading them, and checking the logs' signatures on them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.der import element, inside

STH = "tree_size bigint, timestamp bigint, sha256_root_hash string, tree_head_signature string"


def _bytes(text: Column) -> Column:
    return F.try_to_binary(text, F.lit("base64"))


def parse_sth(raw: DataFrame, text: str = "value") -> DataFrame:
    """RFC 6962 tree heads from JSON text; a head without a size is an error."""
    read = raw.withColumn("_j", F.from_json(text, STH))
    return (
        read.withColumn("tree_size", F.col("_j.tree_size")).withColumn("timestamp", F.col("_j.timestamp"))
        .withColumn("ts", F.timestamp_millis("_j.timestamp")).withColumn("root_hash", _bytes(F.col("_j.sha256_root_hash")))
        .withColumn("signature", _bytes(F.col("_j.tree_head_signature")))
        .withColumn("error", F.when(F.col("tree_size").isNull(), "a tree head without tree_size"))
        .withColumn("kind", F.lit("rfc6962")).drop("_j", text)
    )


def parse_checkpoints(raw: DataFrame, text: str = "value") -> DataFrame:
    """Static log checkpoints: header, extension lines and signature lines."""
    halves = F.split(F.col(text), "\n\n", 2)
    lines = F.split(halves[0], "\n")
    size = F.regexp_extract(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"^(\d+)$", 1)
    signed = F.filter(F.split(F.get(halves, F.lit(1)), "\n"), lambda s: s.rlike("^— .* "))
    read = (
        raw.withColumn("_lines", lines).withColumn("_signed", signed)
        .withColumn("origin", F.get("_lines", F.lit(0))).withColumn("tree_size", F.nullif(size, F.lit("")).cast("bigint"))
        .withColumn("root_hash", _bytes(F.coalesce(F.get("_lines", F.lit(2)), F.lit(""))))
        .withColumn("extensions", F.slice("_lines", 4, F.greatest(F.size("_lines") - 3, F.lit(0))))
        .withColumn("signatures", F.transform("_signed", lambda s: F.struct(
            F.regexp_extract(s, "^— (.*) [^ ]*$", 1).alias("name"),
            _bytes(F.regexp_extract(s, " ([^ ]*)$", 1)).alias("sig"))))
    )
    error = (
        F.when(F.size(halves) < 2, "no signatures below the checkpoint")
        .when((F.col("origin") == "") | F.col("tree_size").isNull(), "the checkpoint's first lines cannot be read")
        .when(F.col("root_hash").isNull() | (F.octet_length("root_hash") != 32), "the checkpoint's hash is not 32 bytes"))
    return read.withColumn("error", error).withColumn("kind", F.lit("static")).drop("_lines", "_signed", text)


# --- signatures --------------------------------------------------------------
# Curve P-256, public domain parameters.
_P = 2**256 - 2**224 + 2**192 + 2**96 - 1
_N = 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551
_B = 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B
_G = (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296,
      0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5)
_EC_HEAD = bytes.fromhex("3059301306072a8648ce3d020106082a8648ce3d03010703420004")
_RSA_OID = bytes.fromhex("06092a864886f70d010101")
_SHA256_INFO = bytes.fromhex("3031300d060960864801650304020105000420")


def point_add(a, b):
    if a is None or b is None:
        return a or b
    if a[0] == b[0]:
        if (a[1] + b[1]) % _P == 0:
            return None
        slope = (3 * a[0] * a[0] - 3) * pow(2 * a[1], -1, _P)
    else:
        slope = (b[1] - a[1]) * pow(b[0] - a[0], -1, _P)
    x = (slope * slope - a[0] - b[0]) % _P
    return x, (slope * (a[0] - x) - a[1]) % _P


def point_times(k: int, point):
    total = None
    while k:
        if k & 1:
            total = point_add(total, point)
        point, k = point_add(point, point), k >> 1
    return total


def _integers(der: bytes) -> list[int]:
    """Integers of a DER sequence of integers."""
    _, start, end = element(der, 0, len(der))
    return [int.from_bytes(der[s:e]) for _, s, e in inside(der, start, end)]


def signature_holds(data: bytes, signature: bytes, key: bytes) -> bool:
    """SHA-256 signature over data with an SPKI key, ECDSA P-256 or RSA PKCS#1."""
    digest = hashlib.sha256(data).digest()
    try:
        if key.startswith(_EC_HEAD) and len(key) == len(_EC_HEAD) + 64:
            x, y = int.from_bytes(key[-64:-32]), int.from_bytes(key[-32:])
            if (y * y - x * x * x + 3 * x - _B) % _P:
                return False
            r, s = _integers(signature)
            if not (0 < r < _N and 0 < s < _N):
                return False
            inverse = pow(s, -1, _N)
            found = point_add(point_times(int.from_bytes(digest) * inverse % _N, _G), point_times(r * inverse % _N, (x, y)))
            return found is not None and found[0] % _N == r
        if _RSA_OID in key[:40]:
            body = key[key.index(b"\x03", key.index(_RSA_OID) + len(_RSA_OID)):]
            _, start, end = element(body, 0, len(body))
            modulus, exponent = _integers(body[start + 1:end])
            size = (modulus.bit_length() + 7) // 8
            opened = pow(int.from_bytes(signature), exponent, modulus).to_bytes(size)
            tail = _SHA256_INFO + digest
            return len(signature) == size and opened == b"\x00\x01" + b"\xff" * (size - len(tail) - 3) + b"\x00" + tail
    except ValueError:
        pass
    return False


@F.arrow_udf(T.BooleanType())
def _holds_udf(data: pa.Array, signed: pa.Array, key: pa.Array) -> pa.Array:
    def holds(d, s, k):
        # Hash algorithm (4 is SHA-256), signature algorithm, length, signature.
        if d is None or s is None or k is None or len(s) < 4 or s[0] != 4:
            return False
        size = int.from_bytes(s[2:4])
        return len(s) >= 4 + size and signature_holds(d, s[4:4 + size], k)

    return pa.array([holds(*row) for row in zip(data.to_pylist(), signed.to_pylist(), key.to_pylist())], pa.bool_())


def _eight(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 16, F.lit("0")))


def signed_bytes(timestamp: Column, tree_size: Column, root: Column) -> Column:
    """What a log signs: version, type, time, size and root."""
    return F.concat(F.lit(b"\x00\x01"), _eight(timestamp), _eight(tree_size), root)


def verify_heads(heads: DataFrame, logs: DataFrame) -> DataFrame:
    """Add ``signature_ok`` (null without a key) and the signed ``timestamp``.

    ``heads`` carries log_url and the columns of ``parse_sth`` or
    ``parse_checkpoints``; a checkpoint is checked by the signature line that
    bears its log's key id.
    """
    keyed = heads.join(logs.select(F.col("url").alias("log_url"), "key"), "log_url", "left").withColumn("_key", _bytes(F.col("key")))
    if "signatures" in heads.columns:
        log_id = F.unhex(F.sha2("_key", 256))
        key_id = F.substring(F.sha2(F.concat(F.encode(F.concat("origin", F.lit("\n")), "UTF-8"), F.lit(b"\x05"), log_id), 256), 1, 8)
        own = F.filter("signatures", lambda s: (s["name"] == F.col("origin")) & (F.octet_length(s["sig"]) >= 12)
                       & (F.lower(F.hex(F.substring(s["sig"], 1, 4))) == F.col("_key_id")))
        lines = (
            keyed.withColumn("_key_id", key_id).withColumn("_row", F.monotonically_increasing_id())
            .withColumn("_own", own).withColumn("_line", F.explode_outer("_own"))
            .withColumn("timestamp", F.conv(F.hex(F.substring("_line.sig", 5, 8)), 16, 10).cast("bigint"))
            .withColumn("_ok", _holds_udf(signed_bytes(F.col("timestamp"), F.col("tree_size"), F.col("root_hash")),
                                          F.substr(F.col("_line.sig"), F.lit(13)), "_key"))
        )
        # By row, so that two equal polls stay two.
        checked = lines.groupBy("_row", "log_url", *[c for c in heads.columns if c != "log_url"], "key").agg(
            F.max("_ok").alias("_ok"), F.max(F.when(F.col("_ok"), F.col("timestamp"))).alias("timestamp")).drop("_row")
    else:
        checked = keyed.withColumn("_ok", _holds_udf(
            signed_bytes(F.col("timestamp"), F.col("tree_size"), F.col("root_hash")), "signature", "_key")).drop("_key")
    return checked.withColumn("signature_ok", F.when(F.col("key").isNotNull(), F.col("_ok"))).drop("_ok", "key")


def trust_heads(heads: DataFrame, mode: str = "warn") -> tuple[DataFrame, DataFrame]:
    """Heads to use, and failures per log.

    ``warn`` counts failures and still uses the head, ``enforce`` leaves it
    out, ``off`` checks nothing. A log without a key is not checked.
    """
    if mode not in ("warn", "enforce", "off"):
        raise ValueError("mode must be warn, enforce or off")
    failed = F.lit(False) if mode == "off" else F.coalesce(~F.col("signature_ok"), F.lit(False))
    failures = heads.filter(failed).groupBy("log_url").agg(F.count(F.lit(1)).alias("signature_failures"))
    return (heads.filter(~failed) if mode == "enforce" else heads), failures
