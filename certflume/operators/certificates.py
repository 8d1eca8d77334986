"""Certificates: from DER bytes to typed columns and published messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import let
from ..functions.der_columns import outline_lists_udf, outline_udf

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
NAME_ORDER = ("C", "ST", "L", "O", "OU", "CN", "emailAddress")
LEAF_FIELDS = ("all_domains", "extensions", "fingerprint", "sha1", "sha256", "issuer", "not_after", "not_before",
               "serial_number", "signature_algorithm", "subject", "is_ca")
CHAIN_FIELDS = ("subject", "issuer", "extensions", "not_before", "not_after", "serial_number", "fingerprint", "sha256",
                "signature_algorithm", "is_ca", "as_der")


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])


def _label(values: dict[str, str], oid: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(values), oid), oid)


def colon_hex(data: Column) -> Column:
    return F.regexp_replace(F.hex(data), r"(..)(?!$)", "$1:")


def fingerprints(der: Column) -> Column:
    return F.struct(F.regexp_replace(F.upper(F.sha1(der)), r"(..)(?!$)", "$1:").alias("sha1"),
                    F.regexp_replace(F.upper(F.sha2(der, 256)), r"(..)(?!$)", "$1:").alias("sha256"))


def serial_hex(serial: Column) -> Column:
    digits = F.regexp_replace(F.hex(serial), "^0+", "")
    return F.when(digits == "", "0").otherwise(digits)


def distinguished_name(pairs: Column) -> Column:
    """First value of each field, and all values in order."""
    oids = {field: oid for oid, field in fv.NAME_FIELDS.items()}

    def first(field: str) -> Column:
        return F.get(F.filter(pairs, lambda p: p["oid"] == oids[field]), F.lit(0))["value"].alias(field)

    written = F.transform(pairs, lambda p: F.concat(F.lit("/"), _label(fv.NAME_LABELS, p["oid"]), F.lit("="), p["value"]))
    return F.struct(*[first(f) for f in NAME_ORDER], F.array_join(written, "").alias("aggregated"))


def collect_domains(cn: Column, sans: Column) -> Column:
    """The common name when it looks like a host, then the DNS names, once each."""
    lead = F.when(cn.rlike(r"^[^\s/]+\.[^\s/]+$"), F.array(cn)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(lead, sans), lambda d: (d != "") & (F.length(d) <= 253)))


# --- extensions --------------------------------------------------------------

def _children(nodes: Column, up: Column) -> Column:
    return F.filter(nodes, lambda n: n["up"] == up)


def _ip(data: Column) -> Column:
    def part(i: int, n: int) -> Column:
        return F.conv(F.hex(F.substring(data, i, n)), 16, 16 if n == 2 else 10)

    v4 = F.concat_ws(".", *[part(i, 1) for i in range(1, 5)])
    v6 = F.concat_ws(":", *[part(i, 2) for i in range(1, 17, 2)])
    size = F.octet_length(data)
    return F.when(size == 4, v4).when(size == 16, v6).otherwise(colon_hex(data))


def _general_names(nodes: Column) -> Column:
    """Printable general names; other kinds are left out."""
    def written(n: Column) -> Column:
        return (F.when(n["tag"] == 0x82, F.concat(F.lit("DNS:"), n["text"]))
                .when(n["tag"] == 0x87, F.concat(F.lit("IP Address:"), _ip(n["data"])))
                .when(n["tag"] == 0x81, F.concat(F.lit("email:"), n["text"]))
                .when(n["tag"] == 0x86, F.concat(F.lit("URI:"), n["text"])))

    return F.filter(F.transform(nodes, written), lambda t: t.isNotNull())


def _key_usage(nodes: Column) -> Column:
    bits = nodes[0]["data"]
    names = [
        F.when(F.octet_length(bits) > 1 + i // 8,
               F.when(F.conv(F.hex(F.substring(bits, 2 + i // 8, 1)), 16, 10).cast("int").bitwiseAND(0x80 >> i % 8) != 0, label))
        for i, label in enumerate(fv.KEY_USAGE_BITS)
    ]
    return F.array_join(F.array_compact(F.array(*names)), ", ")


def _basic_constraints(nodes: Column) -> Column:
    inner = _children(nodes, F.lit(0))
    ca = _is_ca(nodes)
    length = F.element_at(F.filter(inner, lambda n: n["tag"] == 2), -1)
    path = F.conv(F.hex(length["data"]), 16, 10)
    has = F.exists(inner, lambda n: n["tag"] == 2)
    return F.concat(F.when(ca, "CA:TRUE").otherwise("CA:FALSE"), F.when(has, F.concat(F.lit(", pathlen:"), path)).otherwise(""))


def _is_ca(nodes: Column) -> Column:
    flags = F.filter(_children(nodes, F.lit(0)), lambda n: n["tag"] == 1)
    last = F.try_element_at(flags, F.lit(-1))["data"]
    return F.coalesce(F.hex(F.substring(last, 1, 1)) != "00", F.lit(False))


def _authority_key(nodes: Column) -> Column:
    key = F.get(F.filter(_children(nodes, F.lit(0)), lambda n: n["tag"] == 0x80), F.lit(0))["data"]
    return F.concat(F.lit("keyid:"), colon_hex(key), F.lit("\n"))


def _information_access(nodes: Column) -> Column:
    def line(access: Column) -> Column:
        parts = _children(nodes, access["i"])
        method, place = F.get(parts, F.lit(0))["text"], F.get(parts, F.lit(1))
        return F.when(place["tag"] == 0x86, F.concat(_label(fv.ACCESS_METHODS, method), F.lit(" - URI:"), place["text"], F.lit("\n")))

    return F.array_join(F.array_compact(F.transform(_children(nodes, F.lit(0)), line)), "")


def _policies(nodes: Column) -> Column:
    lines = F.transform(_children(nodes, F.lit(0)),
                        lambda p: F.concat(F.lit("Policy: "), F.get(_children(nodes, p["i"]), F.lit(0))["text"]))
    return F.array_join(lines, "\n")


def _crl_points(nodes: Column) -> Column:
    def first_a0(up: Column) -> Column:
        return F.get(F.filter(_children(nodes, up), lambda n: n["tag"] == 0xA0), F.lit(0))["i"]

    fulls = F.array_compact(F.transform(_children(nodes, F.lit(0)), lambda p: first_a0(first_a0(p["i"]))))
    lines = F.transform(fulls, lambda f: F.concat(
        F.lit("Full Name:\n "), F.array_join(_general_names(_children(nodes, f)), "\n ")))
    return F.array_join(lines, "\n")


def _base64url(data: Column) -> Column:
    text = F.replace(F.replace(F.base64(data), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    return F.regexp_replace(text, r"[=\r\n]+", "")


def extensions_struct(ext: Column, bind=lambda value, use: use(value)) -> Column:
    """Decoded extensions by name; null where a certificate has none.

    ``bind`` holds what is read many times: inside a lambda nothing else does.
    """
    def nodes_of(name: str) -> Column:
        # The last one wins when an extension is repeated.
        return F.try_element_at(F.filter(ext, lambda e: e["oid"] == fv.EXTENSION_OIDS[name]), F.lit(-1))

    def read(name: str, make) -> Column:
        found = nodes_of(name)
        return bind(found, lambda f: F.when(f.isNotNull(), bind(f["nodes"], make))).alias(name)

    return F.struct(
        read("keyUsage", _key_usage),
        read("extendedKeyUsage", lambda n: F.array_join(F.transform(
            _children(n, F.lit(0)), lambda c: _label(fv.EXTENDED_KEY_USAGE, c["text"])), ", ")),
        read("basicConstraints", _basic_constraints),
        read("subjectKeyIdentifier", lambda n: colon_hex(n[0]["data"])),
        read("authorityKeyIdentifier", _authority_key),
        read("authorityInfoAccess", _information_access),
        read("subjectAltName", lambda n: F.array_join(_general_names(_children(n, F.lit(0))), ", ")),
        read("certificatePolicies", _policies),
        read("crlDistributionPoints", _crl_points),
        _base64url(nodes_of("ctlSignedCertificateTimestamp")["value"]).alias("ctlSignedCertificateTimestamp"),
        F.when(nodes_of("ctlPoisonByte").isNotNull(), F.lit(True)).alias("ctlPoisonByte"),
    )


def _by_oid(ext: Column, name: str) -> Column:
    return F.filter(ext, lambda e: e["oid"] == fv.EXTENSION_OIDS[name])


def _parsed(o: Column, subject: Column, issuer: Column, extensions: Column) -> Column:
    """Typed fields of an outline."""
    ext = o["extensions"]
    sans = F.transform(F.flatten(F.transform(_by_oid(ext, "subjectAltName"), lambda e: F.filter(
        e["nodes"], lambda n: (n["up"] == 0) & (n["tag"] == 0x82)))), lambda n: n["text"])
    basic = F.try_element_at(_by_oid(ext, "basicConstraints"), F.lit(-1))
    return F.struct(
        subject.alias("subject"), issuer.alias("issuer"), extensions.alias("extensions"),
        o["not_before"].alias("not_before"), o["not_after"].alias("not_after"),
        serial_hex(o["serial"]).alias("serial_number"),
        _label(fv.SIGNATURE_ALGORITHMS, o["algorithm"]).alias("signature_algorithm"),
        F.when(basic.isNotNull(), _is_ca(basic["nodes"])).otherwise(False).alias("is_ca"),
        F.coalesce(extensions["ctlPoisonByte"], F.lit(False)).alias("is_precert"),
        collect_domains(subject["CN"], sans).alias("all_domains"))


def parse_certificates(df: DataFrame, der: str = "der") -> DataFrame:
    """Add ``parsed`` and ``error``; an unreadable certificate has only the error.

    One Arrow pass cuts the DER apart (only the DER column leaves the JVM);
    every field is then a Column expression over the parts.
    """
    cut = df.withColumn("_o", outline_udf(F.col(der)))
    parsed = (
        cut.withColumn("_subject", distinguished_name(F.col("_o.subject")))
        .withColumn("_issuer", distinguished_name(F.col("_o.issuer")))
        .withColumn("_ext", extensions_struct(F.col("_o.extensions")))
        .withColumn("parsed", F.when(F.col("_o.error").isNull(), _parsed(F.col("_o"), F.col("_subject"), F.col("_issuer"), F.col("_ext"))))
        .withColumn("error", F.col("_o.error"))
    )
    return parsed.drop("_o", "_subject", "_issuer", "_ext")


def cert_names(certs: DataFrame, *keys: str) -> DataFrame:
    """One row per certificate and name, with the name's position."""
    return certs.select(*keys, F.posexplode("parsed.all_domains").alias("pos", "domain"))


# --- objects and messages ----------------------------------------------------

def leaf_object(parsed: Column, der: Column, prints: Column, full: bool = False) -> Column:
    values = {f: parsed[f] for f in LEAF_FIELDS if f not in ("fingerprint", "sha1", "sha256")}
    values |= {"fingerprint": prints["sha1"], "sha1": prints["sha1"], "sha256": prints["sha256"]}
    fields = [values[f].alias(f) for f in LEAF_FIELDS]
    if full:
        fields.append(F.regexp_replace(F.base64(der), r"[\r\n]", "").alias("as_der"))
    return F.struct(*fields)


def chain_object(parsed: Column, der: Column, prints: Column) -> Column:
    values = {f: parsed[f] for f in CHAIN_FIELDS if f not in ("fingerprint", "sha256", "as_der")}
    values |= {"fingerprint": prints["sha1"], "sha256": prints["sha256"],
               "as_der": F.regexp_replace(F.base64(der), r"[\r\n]", "")}
    return F.struct(*[values[f].alias(f) for f in CHAIN_FIELDS])


def resolve_chains(entries: DataFrame, issuers: DataFrame) -> DataFrame:
    """Add ``chain``: issuer certificates of ``chain_fps`` in order, missing ones left out.

    Each distinct chain is resolved once and joined back to its entries, so a
    common chain is never gathered per entry. Entries that brought their chain
    and have no fingerprints keep it.
    """
    brought = F.col("chain") if "chain" in entries.columns else F.lit(None).cast("array<binary>")
    entries = entries.withColumn("_brought", brought).drop("chain")
    lists = entries.select("chain_fps").distinct()
    found = (
        lists.select("chain_fps", F.posexplode("chain_fps").alias("pos", "fp"))
        .join(issuers.select("fp", F.col("der").alias("issuer_der")), "fp")
        .groupBy("chain_fps").agg(F.array_sort(F.collect_list(F.struct("pos", "issuer_der"))).alias("_c"))
        .select("chain_fps", F.transform("_c", lambda c: c["issuer_der"]).alias("chain"))
    )
    own = F.when(F.col("chain_fps").isNull(), F.col("_brought"))
    return entries.join(found, "chain_fps", "left").withColumn(
        "chain", F.coalesce("chain", own, F.array().cast("array<binary>"))).drop("_brought")


def _message(certs: DataFrame, full: bool) -> Column:
    fields = [
        F.when(F.col("entry_type") == 1, "PrecertLogEntry").otherwise("X509LogEntry").alias("update_type"),
        leaf_object(F.col("parsed"), F.col("der"), F.col("fingerprints"), full).alias("leaf_cert"),
        F.col("index").alias("cert_index"), F.col("link").alias("cert_link"),
        (F.unix_micros("seen") / 1e6).alias("seen"),
        F.struct(F.col("log_name").alias("name"), F.col("log_url").alias("url")).alias("source"),
    ]
    if full:
        fields.append(F.col("chain_objects").alias("chain"))
    return F.struct(F.lit("certificate_update").alias("message_type"), F.struct(*fields).alias("data"))


def lite_messages(certs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Messages without DER and chain; ``carry`` names columns that stay beside them."""
    return certs.select(_message(certs, False).alias("message"), *carry)


def chain_objects(certs: DataFrame) -> DataFrame:
    """Add ``chain_objects``: the certificates of ``chain`` as published objects; unreadable ones left out.

    A chain is read where its row is, so no row is shuffled; what a batch of rows has in common is cut apart once.
    """
    def published(o: Column, i: Column) -> Column:
        der = F.get("chain", i)
        made = let(distinguished_name(o["subject"]), lambda s: let(distinguished_name(o["issuer"]), lambda n: let(
            extensions_struct(o["extensions"], let), lambda e: let(_parsed(o, s, n, e), lambda p: let(
                fingerprints(der), lambda f: chain_object(p, der, f))))))
        return F.when(o["error"].isNull(), made)

    cut = certs.withColumn("_outlines", outline_lists_udf(F.col("chain")))
    return cut.withColumn("chain_objects", F.array_compact(F.transform("_outlines", published))).drop("_outlines")


def full_messages(certs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Messages with the DER and the chain as objects."""
    return chain_objects(certs).select(_message(certs, True).alias("message"), *carry)


def domains_messages(certs: DataFrame) -> DataFrame:
    return certs.select(F.struct(F.lit("dns_entries").alias("message_type"), F.col("parsed.all_domains").alias("data")).alias("message"))


def as_json(messages: DataFrame) -> DataFrame:
    return messages.select(F.to_json("message", {"ignoreNullFields": "false"}).alias("value"))
