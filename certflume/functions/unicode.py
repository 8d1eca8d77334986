"""Unicode helpers for names that are not plain ASCII.

Spark has no Unicode normalisation and no punycode codec, so these few steps
run as Arrow UDFs. Callers pass null for plain ASCII rows (nearly all of
them), so the Python side only ever sees the names that need it.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from .. import fixed_values as fv

_DROP = {c: None for lo, hi in fv.MARK_RANGES for c in range(lo, hi + 1)}
_DIGITS = {z + d: str(d) for z in fv.ARABIC_DIGIT_ZEROS for d in range(10)}
_LETTERS = {ord(a): b for table in fv.LOOKALIKES.values() for a, b in table.items()}
_FOLD = _DIGITS | _LETTERS

# Characters an ASCII host may never hold.
FORBIDDEN_HOST = r"[\x00-\x20\x7f\"#%/:<>?@\[\\\]^`{|}]"
_FORBIDDEN = set('"#%/:<>?@[\\]^`{|} \x7f') | {chr(c) for c in range(0x20)}
_IGNORED = {c: None for c in (0x00AD, 0x200B, 0x2060, 0xFEFF, *range(0xFE00, 0xFE10))}
_DOTS = {0x3002: ".", 0xFF0E: ".", 0xFF61: "."}

FOLDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("from", T.ArrayType(T.IntegerType()))])
ODD_CHAR = T.StructType([T.StructField("at", T.IntegerType())]
                        + [T.StructField(f, T.StringType()) for f in ("char", "as", "code", "script")])


def fold_text(text: str) -> str:
    """Compatibility form, lower case, no marks, look-alikes read as Latin."""
    spread = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower())
    return spread.translate(_DROP).translate(_FOLD)


_FOLDED: dict[str, str] = {}  # characters met so far; bounded by the characters that exist


def _fold_char(ch: str) -> str:
    if ch not in _FOLDED:
        _FOLDED[ch] = fold_text(ch)
    return _FOLDED[ch]


def fold_with_origin(text: str) -> dict:
    folded = [(c, i) for i, ch in enumerate(text) for c in _fold_char(ch)]
    return {"text": "".join(c for c, _ in folded), "from": [i for _, i in folded]}


def _shown_label(label: str) -> str:
    if not label.lower().startswith("xn--"):
        return label
    try:
        shown = label[4:].lower().encode("ascii").decode("punycode")
    except (UnicodeError, ValueError, OverflowError):
        return label
    return label if shown.isascii() else shown


def shown_domain(domain: str) -> str:
    """Unicode form of a name; labels that do not decode stay as written."""
    return ".".join(_shown_label(label) for label in domain.split("."))


def ascii_domain(host: str) -> str:
    """ASCII form of a host, or the empty string when it is not a host."""
    mapped = unicodedata.normalize("NFKC", host.translate(_DOTS).translate(_IGNORED)).lower()
    mapped = unicodedata.normalize("NFC", mapped).translate(_DOTS)
    if not mapped or _FORBIDDEN & set(mapped):
        return ""
    labels = [s if s.isascii() else "xn--" + s.encode("punycode").decode() for s in mapped.split(".")]
    return ".".join(labels)


def script_name(ch: str) -> str:
    code = ord(ch)
    script = next((s for lo, hi, s in fv.SCRIPT_RANGES if lo <= code <= hi), "other")
    if script != "latin":
        return script
    return "latin_marked" if len(unicodedata.normalize("NFD", ch)) > 1 else "latin_variant"


def odd_chars_in(text: str, start: int, stop: int) -> list[dict]:
    """Characters of a span that folding changed, with what they read as."""
    return [
        {"at": i, "char": ch, "as": _fold_char(ch), "code": f"U+{ord(ch):04X}", "script": script_name(ch)}
        for i, ch in enumerate(text[start:stop], start)
        if _fold_char(ch) != ch.lower()
    ]


def _each(fn, *arrays, dtype):
    rows = zip(*(a.to_pylist() for a in arrays))
    return pa.array([None if r[0] is None else fn(*r) for r in rows], type=dtype)


_MAPPED = pa.struct([("text", pa.string()), ("from", pa.list_(pa.int32()))])
_ODD = pa.list_(pa.struct([("at", pa.int32()), ("char", pa.string()), ("as", pa.string()),
                           ("code", pa.string()), ("script", pa.string())]))


@F.arrow_udf(T.StringType())
def _fold_udf(text: pa.Array) -> pa.Array:
    return _each(fold_text, text, dtype=pa.string())


@F.arrow_udf(FOLDED)
def _fold_map_udf(text: pa.Array) -> pa.Array:
    return _each(fold_with_origin, text, dtype=_MAPPED)


@F.arrow_udf(T.StringType())
def _shown_udf(domain: pa.Array) -> pa.Array:
    return _each(shown_domain, domain, dtype=pa.string())


@F.arrow_udf(T.StringType())
def _ascii_udf(host: pa.Array) -> pa.Array:
    return _each(ascii_domain, host, dtype=pa.string())


@F.arrow_udf(T.StringType())
def _script_udf(ch: pa.Array) -> pa.Array:
    return _each(lambda c: script_name(c[:1]) if c else None, ch, dtype=pa.string())


@F.arrow_udf(T.ArrayType(ODD_CHAR))
def _odd_udf(text: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
    return _each(odd_chars_in, text, start, stop, dtype=_ODD)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def fold(c: Column) -> Column:
    """Folded text: lower case only for ASCII rows."""
    return F.when(is_ascii(c), F.lower(c)).otherwise(_fold_udf(F.when(~is_ascii(c), c)))


def fold_map(c: Column) -> Column:
    """Folded text with, per folded character, the position it came from.

    ``from`` is null for ASCII rows, where every position is its own origin.
    """
    same = F.struct(F.lower(c).alias("text"), F.lit(None).cast("array<int>").alias("from"))
    return F.when(is_ascii(c), same).otherwise(_fold_map_udf(F.when(~is_ascii(c), c)))


def unicode_domain(c: Column) -> Column:
    """The name as a person sees it; unchanged unless it holds ``xn--``."""
    coded = F.contains(c, F.lit("xn--"))
    return F.when(~coded, c).otherwise(_shown_udf(F.when(coded, c)))


def ascii_host(c: Column) -> Column:
    """ASCII form of a lower-case host, empty when it cannot be a host."""
    native = F.when(c.rlike(FORBIDDEN_HOST), F.lit("")).otherwise(c)
    return F.when(is_ascii(c), native).otherwise(_ascii_udf(F.when(~is_ascii(c), c)))


def script_of(c: Column) -> Column:
    return _script_udf(c)


def odd_chars(text: Column, start: Column, stop: Column) -> Column:
    return _odd_udf(text, start, stop)


FORMS = T.StructType([T.StructField("unicode", T.StringType()), *FOLDED.fields,
                      T.StructField("odd", T.ArrayType(ODD_CHAR))])


@F.arrow_udf(FORMS)
def _forms_udf(raw: pa.Array) -> pa.Array:
    def forms(name):
        shown = shown_domain(name)
        return {"unicode": shown, **fold_with_origin(shown), "odd": odd_chars_in(shown, 0, len(shown))}

    return _each(forms, raw, dtype=pa.struct([("unicode", pa.string()), *_MAPPED, ("odd", _ODD)]))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _shown_list_udf(names: pa.Array) -> pa.Array:
    return _each(lambda row: [shown_domain(n) for n in row], names, dtype=pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _ascii_list_udf(hosts: pa.Array) -> pa.Array:
    return _each(lambda row: [ascii_domain(h) for h in row], hosts, dtype=pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _fold_list_udf(names: pa.Array) -> pa.Array:
    return _each(lambda row: [fold_text(shown_domain(n)) for n in row], names, dtype=pa.list_(pa.string()))


def name_forms(raw: Column) -> Column:
    """Unicode form, folded form, origins and odd characters of a name.

    Null for plain ASCII names, which have nothing to add.
    """
    return _forms_udf(F.when(F.contains(raw, F.lit("xn--")) | ~is_ascii(raw), raw))


def unicode_domains(names: Column) -> Column:
    """``unicode_domain`` over a list."""
    coded = F.contains(F.array_join(names, " "), F.lit("xn--"))
    return F.when(~coded, names).otherwise(_shown_list_udf(F.when(coded, names)))


def ascii_hosts(hosts: Column) -> Column:
    """``ascii_host`` over a list."""
    plain = is_ascii(F.array_join(hosts, ""))
    checked = F.transform(hosts, lambda h: F.when(h.rlike(FORBIDDEN_HOST), "").otherwise(h))
    return F.when(plain, checked).otherwise(_ascii_list_udf(F.when(~plain, hosts)))


def fold_names(names: Column) -> Column:
    """Folded Unicode forms of a list of lower-case names or words."""
    text = F.array_join(names, " ")
    plain = is_ascii(text) & ~F.contains(text, F.lit("xn--"))
    return F.when(plain, names).otherwise(_fold_list_udf(F.when(~plain, names)))
