"""Column expressions: cleaning, codes, rounding, distances and small formulas. All JVM side."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

ENERGY = [f"ENE_{m:02d}" for m in range(1, 13)]

# Nominal-voltage code -> kV, as published by the regulator.
VOLTAGE_KV = {
    "0": 0, "1": 0.11, "2": 0.115, "3": 0.12, "4": 0.121, "5": 0.125, "6": 0.127, "7": 0.208,
    "8": 0.216, "9": 0.2165, "10": 0.22, "11": 0.23, "12": 0.231, "13": 0.24, "14": 0.254,
    "15": 0.38, "16": 0.4, "17": 0.44, "18": 0.48, "19": 0.5, "20": 0.6, "21": 0.75, "22": 1,
    "23": 2.3, "24": 3.2, "25": 3.6, "26": 3.785, "27": 3.8, "28": 3.848, "29": 3.985, "30": 4.16,
    "31": 4.2, "32": 4.207, "33": 4.368, "34": 4.56, "35": 5, "36": 6, "37": 6.6, "38": 6.93,
    "39": 7.96, "40": 8.67, "41": 11.4, "42": 11.9, "43": 12, "44": 12.6, "45": 12.7, "46": 13.2,
    "47": 13.337, "48": 13.53, "49": 13.8, "50": 13.86, "51": 14.14, "52": 14.19, "53": 14.4,
    "54": 14.835, "55": 15, "56": 15.2, "57": 19.053, "58": 19.919, "59": 21, "60": 21.5, "61": 22,
    "62": 23, "63": 23.1, "64": 23.827, "65": 24, "66": 24.2, "67": 25, "68": 25.8, "69": 27,
    "70": 30, "71": 33, "72": 34.5, "73": 36, "74": 38, "75": 40, "76": 44, "77": 45, "78": 45.4,
    "79": 48, "80": 60, "81": 66, "82": 69, "83": 72.5, "84": 88, "85": 88.2, "86": 92, "87": 100,
    "88": 120, "89": 121, "90": 123, "91": 131.6, "92": 131.63, "93": 131.635, "94": 138,
    "95": 145, "96": 230, "97": 345, "98": 500, "99": 750, "100": 1000, "101": 245, "102": 550,
    "103": 11, "104": 11.5, "105": 13, "106": 20, "107": 68, "108": 85, "109": 440,
}
# MV switch type code -> description.
SWITCH_TYPES = {
    "16": "chave a gás",
    "17": "chave a óleo",
    "18": "chave de transferência automática",
    "19": "chave faca",
    "20": "chave faca tripolar com abertura em carga",
    "22": "chave fusível",
    "27": "chave fusível religadora",
    "29": "disjuntor",
    "32": "religador",
    "33": "seccionadora tripolar de subestação",
    "35": "seccionalizador",
}
# Phase codes with one phase conductor; wye phase index; code per index.
SINGLE_PHASE = ("A", "B", "C", "AN", "BN", "CN", "AX", "BX", "CX")
WYE_PHASE = {"AN": 1, "BN": 2, "CN": 3, "A": 1, "B": 2, "C": 3, "AX": 1, "BX": 2, "CX": 3}
PHASE_CODE = {1: "AN", 2: "BN", 3: "CN"}
DELTA_CODES = ("AB", "BC", "CA", "ABN", "BCN", "CAN", "ABC", "ABCN")


def literal_map(table: dict) -> Column:
    """A small fixed table as a map literal (folded into the plan, no join)."""
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])


# --- cleaning --------------------------------------------------------------------------------


def text_or_null(c: Column) -> Column:
    """Trim; blank becomes null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def text_or_empty(c: Column) -> Column:
    """Trim; null becomes the empty text."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def code_text(c: Column, is_float: bool = False) -> Column:
    """Code as text: an integer-valued float loses its fraction, null becomes the empty text."""
    if not is_float:
        return text_or_empty(c)
    whole = c == F.floor(c)
    return F.when(c.isNull() | F.isnan(c), F.lit("")).otherwise(
        F.when(whole, c.cast("long").cast("string")).otherwise(F.trim(c.cast("string")))
    )


def number(c: Column) -> Column:
    """Tolerant numeric parse; anything unreadable (and NaN) is null."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.nullif(value, F.lit(float("nan")))


def whole_number(c: Column) -> Column:
    return number(c).try_cast("long")


def timestamp_iso(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.coalesce(text.try_cast("timestamp"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def timestamp_day_first(c: Column) -> Column:
    """``dd/MM/yyyy`` first, then ISO; unreadable is null."""
    text = F.trim(c.cast("string"))
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("dd/MM/yyyy")),
        F.try_to_timestamp(text, F.lit("dd-MM-yyyy")),
        text.try_cast("timestamp"),
    )


# --- arithmetic ------------------------------------------------------------------------------


def round_to(c: Column, places: int) -> Column:
    """Scale, round half to even, scale back: the rounding numpy and pandas apply to doubles."""
    factor = float(10**places)
    return F.rint(c * F.lit(factor)) / F.lit(factor)


def exact_sum(c: Column, scale: int = 6) -> Column:
    """Sum through a decimal so that the result does not depend on partition order."""
    return F.sum(c.cast(f"decimal(28,{scale})")).cast("double")


def percent(part: Column, total: Column) -> Column:
    """``100 * part / total``; zero (or missing) total gives zero."""
    total = total.cast("double")
    return F.when(total.isNull() | (total == 0), F.lit(0.0)).otherwise(
        part.cast("double") * F.lit(100.0) / total
    )


def sum_of_present(columns: Sequence[Column]) -> Column:
    """Row-wise sum that skips nulls and is null only when every value is null."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def truncate_to(c: Column, places: int = 6) -> Column:
    factor = float(10**places)
    scaled = c * F.lit(factor)
    return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)) / F.lit(factor)


def round_record(df, places: int = 4):
    """Round every floating-point column of a frame."""
    out = df
    for field in df.schema.fields:
        if field.dataType.typeName() in ("double", "float"):
            out = out.withColumn(field.name, F.bround(field.name, places))
    return out


# --- domain flags and codes ------------------------------------------------------------------


def first_word(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.trim(c), r"^(\S+)", 1), F.lit(""))


def kilovolts(code: Column) -> Column:
    return F.try_element_at(
        literal_map({k: float(v) for k, v in VOLTAGE_KV.items()}), F.trim(code.cast("string"))
    )


def switch_type(code: Column) -> Column:
    return F.try_element_at(literal_map(SWITCH_TYPES), F.trim(code.cast("string")))


def is_open(position: Column) -> Column:
    return F.coalesce(F.upper(F.trim(position)) == "A", F.lit(False))


def is_remote(flag: Column) -> Column:
    return F.coalesce(number(flag).cast("int") == 1, F.lit(False))


def is_solar(kind: Column, description: Column) -> Column:
    return (F.upper(text_or_empty(kind)) == "UFV") | F.contains(
        F.lower(text_or_empty(description)), F.lit("solar")
    )


def is_single_phase(code: Column) -> Column:
    return F.coalesce(text_or_empty(code).isin(*SINGLE_PHASE), F.lit(False))


def phase_index(code: Column) -> Column:
    return F.try_element_at(literal_map(WYE_PHASE), F.upper(text_or_empty(code)))


def feeder_of_bus(bus: Column) -> Column:
    """Feeder code: the bus name before ``_mt_``, upper case."""
    return F.upper(F.split(bus, "_mt_", 2)[0])


def segment_of_element(element: Column) -> Column:
    """Segment code of a line element ``Line.SMT_<code>`` in any letter case, else null."""
    code = F.regexp_extract(F.trim(element), r"(?i)^line\.smt_(.*)$", 1)
    return F.nullif(F.upper(F.trim(code)), F.lit(""))


def split_codes(c: Column, separator: str = ";") -> Column:
    """``;`` list to an array of trimmed non-blank codes."""
    parts = F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), separator), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def join_codes(c: Column, separator: str = ";") -> Column:
    return F.array_join(c, separator)


def feeder_key(c: Column) -> Column:
    """Upper case, letters and digits only: the comparison form of a feeder name."""
    return F.upper(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^\p{L}\p{N}]", ""))


def feeder_match(target: Column, value: Column) -> Column:
    """``exact`` / ``approximate`` / null: equal keys, or one key inside the other."""
    a, b = feeder_key(target), feeder_key(value)
    present = (a != "") & (b != "")
    return F.when(present & (a == b), F.lit("exact")).when(
        present & (F.contains(a, b) | F.contains(b, a)), F.lit("approximate")
    )


# --- distances -------------------------------------------------------------------------------

EARTH_RADIUS_M = 6378137.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in km."""
    dy = (lat2 - lat1) * F.lit(111.32)
    dx = (lon2 - lon1) * F.lit(111.32) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(dx, dy)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    x = F.radians(lon) * F.lit(EARTH_RADIUS_M)
    y = F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * F.lit(EARTH_RADIUS_M)
    return x, y


def degrees_for_metres(lat_mid: Column, metres: float) -> tuple[Column, Column]:
    """(dx, dy) in degrees of a margin in metres at latitude ``lat_mid``."""
    cosine = F.greatest(F.cos(F.radians(lat_mid)), F.lit(0.01))
    dy = F.lit(metres / 111_320.0)
    return F.lit(metres) / (F.lit(111_320.0) * cosine), dy


# --- semi-structured -------------------------------------------------------------------------


def json_path(payload: Column, path: str) -> Column:
    """``a.b[0].c`` of JSON text as text; ``len(path)`` as a count and ``sum/min/max(path)`` over the
    numbers of an array as doubles. Anything missing is null (P12)."""
    path = path.strip()
    outer, inner = None, path
    if path.endswith(")") and "(" in path:
        outer, inner = path[:-1].split("(", 1)
    value = F.try_parse_json(payload)
    step = "$." + inner if not inner.startswith("[") else "$" + inner
    if outer is None:
        return F.try_variant_get(value, step, "string")
    items = F.try_variant_get(value, step, "array<variant>")
    if outer == "len":
        return F.coalesce(F.size(items), F.size(F.try_variant_get(value, step, "map<string,variant>")))
    if outer not in ("sum", "min", "max"):
        raise ValueError(f"unknown function in path: {path}")
    numbers = F.filter(F.transform(items, lambda v: F.try_variant_get(v, "$", "double")), lambda x: x.isNotNull())
    if outer == "sum":
        total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(numbers) > 0, total)
    return F.array_min(numbers) if outer == "min" else F.array_max(numbers)


# --- scores ----------------------------------------------------------------------------------


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """``1 - C(n-c, k) / C(n, k)`` as a product; k is limited to n, no run gives zero."""
    k = F.least(k, n).cast("int")
    steps = F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)))
    product = F.aggregate(
        steps,
        F.lit(1.0),
        lambda acc, i: acc
        * F.when(i < k, (n - c - i).cast("double") / (n - i).cast("double")).otherwise(1.0),
    )
    return (
        F.when(n <= 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - product)
    )


def minutes_avoided(customers: Column, repair_min: Column, switching_min: Column) -> Column:
    """Customer-minutes saved when supply returns after switching instead of after repair."""
    return customers.cast("double") * F.greatest(repair_min - switching_min, F.lit(0.0))


def dec_hours(customer_minutes: Column, region_customers: Column) -> Column:
    """Average interruption hours of a region for the given customer-minutes."""
    return F.when(region_customers > 0, customer_minutes / region_customers / F.lit(60.0))


def mask_tokens(payload: Column, names: Sequence[str]) -> Column:
    """Replace the value of each secret field in JSON text by a short hash of the value."""
    out = payload
    for name in names:
        found = F.get_json_object(payload, f"$.{name}")
        mask = F.concat(F.lit("sha256:"), F.substring(F.sha2(found, 256), 1, 12))
        usable = found.isNotNull() & ~found.isin("", "***")
        masked = F.regexp_replace(
            out,
            F.concat(F.lit(f'"{name}"\\s*:\\s*"\\Q'), found, F.lit('\\E"')),
            F.concat(F.lit(f'"{name}":"'), mask, F.lit('"')),
        )
        out = F.when(usable, masked).otherwise(out)
    return out


def result_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)
