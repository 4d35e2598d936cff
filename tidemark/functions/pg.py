"""PostgreSQL functions as Spark SQL expressions.

FUNCS maps a name to a builder from argument texts to an expression. Names that mean the same in Spark need no entry.
The operator functions of the types (int4pl, float8lt, texteq ...) follow a rule. Functions that no built-in expresses
are Arrow UDFs of tidemark.functions.udfs, registered under the prefix tm_.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Build = Callable[..., str]

#: pattern signs of PostgreSQL's regular expressions that Java writes otherwise (in quoted, doubled form)
_ESCAPES = {"\\\\m": "\\\\b(?=\\\\w)", "\\\\M": "\\\\b(?<=\\\\w)", "\\\\y": "\\\\b", "\\\\Y": "\\\\B"}


def ranged(r: str) -> str:
    """A quoted pattern with the word marks of PostgreSQL as those of Java."""
    for a, b in _ESCAPES.items():
        r = r.replace(a, b)
    return r


# Date templates of to_char and their Java letters, the longest first.
_TEMPLATES = [
    ("HH24", "HH"), ("HH12", "hh"), ("YYYY", "yyyy"), ("YYY", "yyy"), ("MONTH", "MMMM"), ("Month", "MMMM"), ("month", "MMMM"), ("MON", "MMM"), ("Mon", "MMM"), ("mon", "MMM"),
    ("DDD", "DDD"), ("DAY", "EEEE"), ("Day", "EEEE"), ("DY", "EEE"), ("Dy", "EEE"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("YY", "yy"),
    ("MM", "MM"), ("DD", "dd"), ("AM", "a"), ("PM", "a"), ("Q", "q"), ("TZ", "z"),
]


def template(t: str) -> str | None:
    """A quoted date template for date_format, None if it is one for numbers or no literal."""
    if not t.startswith("'") or re.fullmatch(r"'[90.,SLDGMIPRFB$\s-]+'", t):
        return None
    s, out, upper = t[1:-1].replace("FM", ""), "", None
    while s:
        for a, b in _TEMPLATES:
            if s.startswith(a):
                out, s = out + b, s[len(a) :]
                if a.isalpha() and a.isupper() and a in ("MONTH", "MON", "DAY", "DY"):
                    upper = True
                break
        else:
            out += s[0] if not s[0].isalpha() else f"\\'{s[0]}\\'"
            s = s[1:]
    del upper
    return f"'{out}'"


def _to_char(x: str, t: str) -> str:
    d = template(t)
    return f"date_format({x}, {d})" if d else f"to_char({x}, {t.replace('FM', '')})"


def date_part(field: str, x: str) -> str:
    """extract(field from x), Sunday being day 0."""
    f = field.lower()
    if f == "dow":
        return f"(dayofweek({x}) - 1)"
    if f == "isodow":
        return f"(weekday({x}) + 1)"
    if f == "epoch":
        return f"(unix_micros(cast({x} as timestamp)) / 1000000)"
    if f in ("century", "millennium"):
        return f"ceil(year({x}) / {100 if f == 'century' else 1000})"
    if f == "decade":
        return f"(year({x}) div 10)"
    if f == "milliseconds":
        return f"(extract(second from {x}) * 1000)"
    if f == "microseconds":
        return f"(extract(second from {x}) * 1000000)"
    if f == "isoyear":
        return f"extract(yearofweek from {x})"
    return f"extract({f} FROM {x})"


def json_get(x: str, key: str, index: bool, text: bool) -> str:
    """x -> key and x ->> key."""
    if index:
        return f"get_json_object({x}, concat('$[', {key}, ']'))"
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", key)
    path = f"'$.{m[1]}'" if m and re.fullmatch(r"\w+", m[1]) else f"concat('$[\\'', {key}, '\\']')"
    del text
    return f"get_json_object({x}, {path})"


def _path(x: str, *keys: str) -> str:
    for k in keys:
        m = re.fullmatch(r"'(\d+)'", k)
        x = json_get(x, m[1] if m else k, bool(m), True)
    return x


def _obj(*kv: str) -> str:
    return "to_json(named_struct(" + ", ".join(kv) + "), map('ignoreNullFields', 'false'))"


def _trunc(x: str, n: str = "0") -> str:
    return f"(sign({x}) * floor(abs({x}) * power(10, {n})) / power(10, {n}))"


def _left(x: str, n: str) -> str:
    return f"if({n} >= 0, left({x}, {n}), substring({x}, 1, greatest(length({x}) + ({n}), 0)))"


def _right(x: str, n: str) -> str:
    return f"if({n} >= 0, right({x}, {n}), substring({x}, 1 - ({n})))"


def _substr(x: str, a: str, n: str | None = None) -> str:
    if n is None:
        return f"substring({x}, greatest({a}, 1))" if not a.startswith("'") else f"regexp_extract({x}, {ranged(a)}, 0)"
    return f"substring({x}, greatest({a}, 1), greatest(({n}) + least({a} - 1, 0), 0))"


def _replace(x: str, p: str, r: str, flags: str = "''") -> str:
    f = flags.strip("'")
    mark = "(?i)" if "i" in f else ""
    pat = f"concat('{mark}', {ranged(p)})" if mark else ranged(p)
    rep = re.sub(r"\\\\(\d)", r"$\1", r)
    if "g" in f:
        return f"regexp_replace({x}, {pat}, {rep})"
    # the first match only
    return f"regexp_replace({x}, concat('(?s)^(.*?)(?:', {pat}, ')'), concat('$1', {rep}))" if "$" not in rep else f"tm_regexp_first({x}, {pat}, {r})"


def _date_bin(stride: str, ts: str, origin: str) -> str:
    us = f"(unix_micros(timestamp '1970-01-01 00:00:00 UTC' + {stride}))"
    m = lambda t: f"unix_micros(cast({t} as timestamp))"
    return f"cast(timestamp_micros({m(origin)} + cast(floor(({m(ts)} - {m(origin)}) / {us}) as bigint) * {us}) as timestamp_ntz)"


def _quote_literal(x: str) -> str:
    return f"concat('\\'', replace(cast({x} as string), '\\'', '\\'\\''), '\\'')"


def _same(name: str) -> Build:
    return lambda *a: f"{name}({', '.join(a)})"


def _cast(kind: str) -> Build:
    return lambda x, *_: f"cast({x} as {kind})"


STRINGS: dict[str, Build] = {
    "concat": lambda *a: f"concat_ws('', {', '.join(a)})", "textcat": _same("concat"), "textanycat": _same("concat"), "anytextcat": _same("concat"),
    "convert_from": lambda x, e: f"decode({x}, {e})", "convert_to": lambda x, e: f"encode({x}, {e})",
    "encode": lambda x, f: {"'hex'": f"lower(hex({x}))", "'base64'": f"base64({x})"}.get(f, f"encode({x}, {f})"),
    "decode": lambda x, f: {"'hex'": f"unhex({x})", "'base64'": f"unbase64({x})"}.get(f, f"decode({x}, {f})"),
    "format": lambda f, *a: f"format_string({', '.join([re.sub(r'%[IL]', '%s', f), *a])})",
    "left": _left, "right": _right, "substr": _substr, "substring": _substr, "strpos": lambda x, y: f"instr({x}, {y})",
    "like_escape": lambda x, e: x, "notlike": lambda x, p: f"({x} NOT LIKE {p})", "like": lambda x, p: f"({x} LIKE {p})",
    "quote_ident": lambda x: f"if({x} RLIKE '^[a-z_][a-z0-9_]*$', {x}, concat('\"', replace({x}, '\"', '\"\"'), '\"'))",
    "quote_literal": _quote_literal, "quote_nullable": lambda x: f"coalesce({_quote_literal(x)}, 'NULL')",
    "regexp_match": lambda x, p, *f: f"if({x} RLIKE {ranged(p)}, tm_groups({x}, {ranged(p)}), null)",
    "regexp_matches": lambda x, p, *f: f"explode(tm_all_groups({x}, {ranged(p)}))",
    "regexp_replace": _replace, "regexp_split_to_array": lambda x, p, *f: f"split({x}, {ranged(p)})", "regexp_split_to_table": lambda x, p, *f: f"explode(split({x}, {ranged(p)}))",
    "regexp_like": lambda x, p, f="''": f"({x} RLIKE {'concat(' + repr('(?i)') + ', ' + ranged(p) + ')' if 'i' in f else ranged(p)})",
    "sha224": lambda x: f"tm_sha224({x})", "sha256": lambda x: f"sha2({x}, 256)", "sha384": lambda x: f"sha2({x}, 384)", "sha512": lambda x: f"sha2({x}, 512)",
    "starts_with": lambda x, y: f"startswith({x}, {y})", "to_hex": lambda x: f"lower(hex({x}))", "ascii": lambda x: f"if({x} = '', 0, ascii({x}))",
    "string_to_array": lambda x, d, *n: f"{'transform(' if n else ''}split({x}, concat('\\\\Q', {d}, '\\\\E')){', e -> nullif(e, ' + n[0] + '))' if n else ''}",
    "string_to_table": lambda x, d, *n: f"explode(split({x}, concat('\\\\Q', {d}, '\\\\E')))",
    "is_normalized": lambda x, *f: f"tm_is_normalized({x})", "normalize": lambda x, *f: f"tm_normalize({x})", "parse_ident": lambda x, *s: f"tm_parse_ident({x})", "unistr": lambda x: f"tm_unistr({x})",
    "to_ascii": lambda x, *e: f"tm_to_ascii({x})", "text": _cast("string"), "name": _cast("string"), "bpchar": _cast("string"), "varchar": _cast("string"), "length": _same("length"),
    "similar_to_escape": lambda x, *e: f"tm_similar({x})", "similar_escape": lambda x, *e: f"tm_similar({x})", "initcap": lambda x: f"initcap({x})",
}
MATH: dict[str, Build] = {
    "acosd": lambda x: f"degrees(acos({x}))", "asind": lambda x: f"degrees(asin({x}))", "atand": lambda x: f"degrees(atan({x}))", "atan2d": lambda y, x: f"degrees(atan2({y}, {x}))",
    "cosd": lambda x: f"cos(radians({x}))", "sind": lambda x: f"sin(radians({x}))", "tand": lambda x: f"tan(radians({x}))", "cotd": lambda x: f"cot(radians({x}))",
    "dcbrt": _same("cbrt"), "dexp": _same("exp"), "dlog1": _same("ln"), "dlog10": _same("log10"), "dpow": _same("power"), "dround": lambda x: f"rint({x})", "dsqrt": _same("sqrt"), "dtrunc": _trunc, "trunc": _trunc,
    "log": lambda a, b=None: f"log10({a})" if b is None else f"log({a}, {b})", "erf": lambda x: f"tm_erf({x})", "erfc": lambda x: f"(1 - tm_erf({x}))", "gcd": lambda a, b: f"tm_gcd({a}, {b})", "lcm": lambda a, b: f"if(({a}) = 0 or ({b}) = 0, 0, abs(({a}) div tm_gcd({a}, {b}) * ({b})))",
    "div": lambda a, b: f"cast({_trunc(f'(({a}) / ({b}))')} as bigint)", "mod": lambda a, b: f"(({a}) % ({b}))", "get_bit": lambda x, n: f"getbit({x}, {n})",
    "num_nonnulls": lambda *a: f"({' + '.join(f'if({x} is null, 0, 1)' for x in a)})", "num_nulls": lambda *a: f"({' + '.join(f'if({x} is null, 1, 0)' for x in a)})",
    "random": lambda: "rand()", "random_normal": lambda m="0", s="1": f"(randn() * {s} + {m})", "scale": lambda x: f"length(regexp_extract(cast({x} as string), '\\\\.(.*)$', 1))",
    "min_scale": lambda x: f"length(regexp_extract(cast({x} as string), '\\\\.(.*?)0*$', 1))", "trim_scale": lambda x: f"regexp_replace(cast({x} as string), '\\\\.?0+$', '')",
    "int2": _cast("smallint"), "int4": _cast("int"), "int8": _cast("bigint"), "float4": _cast("float"), "float8": _cast("double"), "bool": _cast("boolean"), "money": _cast("decimal(19,2)"), "numeric": _cast("decimal(38,10)"),
}
DATES: dict[str, Build] = {
    "age": lambda a, b="current_date": f"tm_age(cast({a} as timestamp), cast({b} as timestamp))", "date_bin": _date_bin, "date_part": lambda f, x: date_part(f.strip("'"), x),
    "date_add": lambda t, i, *z: f"({t} + {i})", "date_subtract": lambda t, i, *z: f"({t} - {i})", "date_trunc": lambda f, x, *z: f"cast(date_trunc({f}, {x}) as timestamp_ntz)",
    "clock_timestamp": lambda: "current_timestamp()", "statement_timestamp": lambda: "current_timestamp()", "transaction_timestamp": lambda: "current_timestamp()", "timeofday": lambda: "date_format(current_timestamp(), 'EEE MMM dd HH:mm:ss.SSSSSS yyyy z')",
    "isfinite": lambda x: f"({x} is not null)", "make_timestamptz": lambda *a: f"make_timestamp_ltz({', '.join(a)})", "make_timestamp": lambda *a: f"make_timestamp_ntz({', '.join(a)})",
    "to_char": _to_char, "to_date": lambda x, t: f"to_date({x}, {template(t) or t})", "to_timestamp": lambda x, t=None: f"timestamp_seconds({x})" if t is None else f"to_timestamp({x}, {template(t) or t})",
    "timezone": lambda z, x: f"from_utc_timestamp({x}, {z})", "timestamp": _cast("timestamp_ntz"), "timestamptz": _cast("timestamp"), "time": _cast("time"), "date": _cast("date"),
    "overlaps": lambda a, b, c, d: f"({a} < {d} AND {c} < {b})",
}
ARRAYS: dict[str, Build] = {
    "array_cat": _same("concat"), "array_length": lambda x, *d: f"nullif(size({x}), 0)", "array_upper": lambda x, *d: f"nullif(size({x}), 0)", "array_lower": lambda x, *d: f"if(size({x}) > 0, 1, null)", "cardinality": _same("size"),
    "array_dims": lambda x: f"concat('[1:', size({x}), ']')", "array_ndims": lambda x: f"(length(typeof({x})) - length(replace(typeof({x}), 'array<', ''))) div 6", "array_fill": lambda v, n: f"array_repeat({v}, element_at({n}, 1))",
    "array_position": lambda x, v, *s: f"nullif(array_position({x}, {v}), 0)", "array_positions": lambda x, v: f"filter(transform({x}, (e, i) -> if(e <=> {v}, i + 1, null)), e -> e is not null)", "array_replace": lambda x, a, b: f"transform({x}, e -> if(e <=> {a}, {b}, e))",
    "array_remove": lambda x, v: f"filter({x}, e -> not (e <=> {v}))", "array_sample": lambda x, n: f"slice(shuffle({x}), 1, {n})", "array_shuffle": _same("shuffle"), "array_to_string": _same("array_join"), "trim_array": lambda x, n: f"slice({x}, 1, size({x}) - {n})",
    "arraycontains": lambda a, b: f"forall({b}, e -> array_contains({a}, e))", "arraycontained": lambda a, b: f"forall({a}, e -> array_contains({b}, e))", "arrayoverlap": _same("arrays_overlap"),
    "generate_series": lambda *a: f"explode(sequence({', '.join(a)}))", "generate_subscripts": lambda x, d: f"explode(sequence(1, size({x})))", "unnest": _same("explode"),
}
_J: dict[str, Build] = {
    "array_element": lambda x, i: json_get(x, i, True, False), "array_element_text": lambda x, i: json_get(x, i, True, True), "array_elements": lambda x: f"explode(tm_json_items({x}))", "array_elements_text": lambda x: f"explode(from_json({x}, 'array<string>'))",
    "array_length": lambda x: f"json_array_length({x})", "build_array": lambda *a: f"to_json(array({', '.join(a)}))", "build_object": _obj, "each": lambda x: f"explode(from_json({x}, 'map<string,string>'))", "each_text": lambda x: f"explode(from_json({x}, 'map<string,string>'))",
    "extract_path": _path, "extract_path_text": _path, "object": lambda k, v: f"to_json(map_from_arrays({k}, {v}))", "object_field": lambda x, k: json_get(x, k, False, False), "object_field_text": lambda x, k: json_get(x, k, False, True),
    "object_keys": lambda x: f"explode(json_object_keys({x}))", "object_agg": lambda k, v: f"to_json(map_from_entries(collect_list(struct({k}, {v}))))", "object_agg_strict": lambda k, v: f"to_json(map_filter(map_from_entries(collect_list(struct({k}, {v}))), (a, b) -> b is not null))",
    "object_agg_unique": lambda k, v: f"to_json(map_from_entries(collect_list(struct({k}, {v}))))", "strip_nulls": lambda x: f"tm_json_strip({x})", "typeof": lambda x: f"tm_json_typeof({x})",
    "pretty": lambda x: f"tm_json_pretty({x})", "set": lambda x, p, v, c="true": f"tm_json_set({x}, {p}, {v}, {c})", "set_lax": lambda x, p, v, c="true", *n: f"tm_json_set({x}, {p}, {v}, {c})", "insert": lambda x, p, v, a="false": f"tm_json_insert({x}, {p}, {v}, {a})",
    "concat": lambda a, b: f"tm_json_concat({a}, {b})", "contains": lambda a, b: f"tm_json_contains({a}, {b})", "contained": lambda a, b: f"tm_json_contains({b}, {a})", "delete": lambda x, k: f"tm_json_delete({x}, cast({k} as string))", "delete_path": lambda x, p: f"tm_json_delete_path({x}, {p})",
    "exists": lambda x, k: f"array_contains(json_object_keys({x}), {k})", "exists_all": lambda x, k: f"forall({k}, e -> array_contains(json_object_keys({x}), e))", "exists_any": lambda x, k: f"arrays_overlap(json_object_keys({x}), {k})", "cmp": lambda a, b: f"tm_json_cmp({a}, {b})",
    "path_exists": lambda x, p, *o: f"(size(tm_json_path({x}, {p})) > 0)", "path_query": lambda x, p, *o: f"explode(tm_json_path({x}, {p}))", "path_query_first": lambda x, p, *o: f"try_element_at(tm_json_path({x}, {p}), 1)", "path_query_array": lambda x, p, *o: f"concat('[', array_join(tm_json_path({x}, {p}), ', '), ']')",
    "path_match": lambda x, p, *o: f"(try_element_at(tm_json_path({x}, {p}), 1) = 'true')",
}
JSON: dict[str, Build] = {f"{j}_{k}": f for j in ("json", "jsonb") for k, f in _J.items()} | {
    "array_to_json": lambda x, *p: f"to_json({x})", "row_to_json": lambda x, *p: f"to_json({x}, map('ignoreNullFields', 'false'))", "to_jsonb": lambda x: f"to_json({x})", "to_json": lambda x: f"to_json({x})",
}
_RANGE_KINDS = {"int4range": "int", "int8range": "bigint", "numrange": "decimal(38,10)", "daterange": "date", "tsrange": "timestamp_ntz", "tstzrange": "timestamp"}


def _mk_range(kind: str) -> Build:
    def build(lo: str, hi: str, b: str = "'[)'") -> str:
        li, ui = f"({b} like '[%')", f"({b} like '%]')"
        lo, hi = f"cast({lo} as {kind})", f"cast({hi} as {kind})"
        if kind in ("int", "bigint", "date"):  # discrete ranges are kept as [lo, hi)
            lo, hi, li, ui = f"if({li}, {lo}, {lo} + 1)", f"if({ui}, {hi} + 1, {hi})", "true", "false"
        return f"named_struct('lo', {lo}, 'hi', {hi}, 'lo_inc', {li}, 'hi_inc', {ui})"

    return build


def _before(a: str, b: str) -> str:
    """a ends before b begins."""
    return f"({a}.hi < {b}.lo or ({a}.hi = {b}.lo and not ({a}.hi_inc and {b}.lo_inc)))"


def _empty(a: str) -> str:
    return f"coalesce({a}.lo > {a}.hi or ({a}.lo = {a}.hi and not ({a}.lo_inc and {a}.hi_inc)), false)"


def _overlap(a: str, b: str) -> str:
    return f"(not {_empty(a)} and not {_empty(b)} and not coalesce({_before(a, b)}, false) and not coalesce({_before(b, a)}, false))"


def _in(a: str, x: str) -> str:
    return f"(coalesce({a}.lo < {x} or ({a}.lo = {x} and {a}.lo_inc), true) and coalesce({a}.hi > {x} or ({a}.hi = {x} and {a}.hi_inc), true))"


def _covers(a: str, b: str) -> str:
    return f"({_empty(b)} or (coalesce({a}.lo < {b}.lo or ({a}.lo = {b}.lo and ({a}.lo_inc or not {b}.lo_inc)), {a}.lo is null) and coalesce({a}.hi > {b}.hi or ({a}.hi = {b}.hi and ({a}.hi_inc or not {b}.hi_inc)), {a}.hi is null)))"


def _meet(a: str, b: str) -> str:
    lo = f"case when {b}.lo is null or {a}.lo > {b}.lo or ({a}.lo = {b}.lo and not {a}.lo_inc) then struct({a}.lo as v, {a}.lo_inc as i) else struct({b}.lo as v, {b}.lo_inc as i) end"
    hi = f"case when {b}.hi is null or {a}.hi < {b}.hi or ({a}.hi = {b}.hi and not {a}.hi_inc) then struct({a}.hi as v, {a}.hi_inc as i) else struct({b}.hi as v, {b}.hi_inc as i) end"
    return f"if({_overlap(a, b)}, named_struct('lo', ({lo}).v, 'hi', ({hi}).v, 'lo_inc', ({lo}).i, 'hi_inc', ({hi}).i), null)"


RANGES: dict[str, Build] = {k: _mk_range(v) for k, v in _RANGE_KINDS.items()} | {
    "isempty": _empty, "lower_inc": lambda a: f"{a}.lo_inc", "upper_inc": lambda a: f"{a}.hi_inc", "lower_inf": lambda a: f"({a}.lo is null)", "upper_inf": lambda a: f"({a}.hi is null)", "range_lower": lambda a: f"{a}.lo", "range_upper": lambda a: f"{a}.hi",
    "range_overlaps": _overlap, "range_contains": _covers, "range_contained_by": lambda a, b: _covers(b, a), "range_contains_elem": _in, "elem_contained_by_range": lambda x, a: _in(a, x), "range_before": lambda a, b: f"coalesce({_before(a, b)}, false)", "range_after": lambda a, b: f"coalesce({_before(b, a)}, false)",
    "range_adjacent": lambda a, b: f"coalesce(({a}.hi = {b}.lo and {a}.hi_inc <> {b}.lo_inc) or ({b}.hi = {a}.lo and {b}.hi_inc <> {a}.lo_inc), false)", "range_intersect": _meet, "range_eq": lambda a, b: f"({a} <=> {b})", "range_ne": lambda a, b: f"(not ({a} <=> {b}))",
    "range_merge": lambda a, b: f"named_struct('lo', if({a}.lo is null or {b}.lo is null, null, least({a}.lo, {b}.lo)), 'hi', if({a}.hi is null or {b}.hi is null, null, greatest({a}.hi, {b}.hi)), 'lo_inc', if({a}.lo <= {b}.lo, {a}.lo_inc, {b}.lo_inc), 'hi_inc', if({a}.hi >= {b}.hi, {a}.hi_inc, {b}.hi_inc))",
    "range_overleft": lambda a, b: f"({a}.hi <= {b}.hi)", "range_overright": lambda a, b: f"({a}.lo >= {b}.lo)",
}
_PT = lambda a, b: f"sqrt(power({a}.x - {b}.x, 2) + power({a}.y - {b}.y, 2))"
GEO: dict[str, Build] = {
    "point": lambda x, y: f"named_struct('x', cast({x} as double), 'y', cast({y} as double))", "point_distance": _PT, "point_add": lambda a, b: f"named_struct('x', {a}.x + {b}.x, 'y', {a}.y + {b}.y)", "point_sub": lambda a, b: f"named_struct('x', {a}.x - {b}.x, 'y', {a}.y - {b}.y)",
    "point_left": lambda a, b: f"({a}.x < {b}.x)", "point_right": lambda a, b: f"({a}.x > {b}.x)", "point_above": lambda a, b: f"({a}.y > {b}.y)", "point_below": lambda a, b: f"({a}.y < {b}.y)", "point_horiz": lambda a, b: f"({a}.y = {b}.y)", "point_vert": lambda a, b: f"({a}.x = {b}.x)", "point_eq": lambda a, b: f"({a}.x = {b}.x and {a}.y = {b}.y)",
    "box": lambda a, b: f"named_struct('x1', greatest({a}.x, {b}.x), 'y1', greatest({a}.y, {b}.y), 'x0', least({a}.x, {b}.x), 'y0', least({a}.y, {b}.y))", "area": lambda a: f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))", "width": lambda a: f"({a}.x1 - {a}.x0)", "box_center": lambda a: f"named_struct('x', ({a}.x1 + {a}.x0) / 2, 'y', ({a}.y1 + {a}.y0) / 2)",
    "box_contain_pt": lambda a, p: f"({p}.x between {a}.x0 and {a}.x1 and {p}.y between {a}.y0 and {a}.y1)", "box_overlap": lambda a, b: f"({a}.x0 <= {b}.x1 and {b}.x0 <= {a}.x1 and {a}.y0 <= {b}.y1 and {b}.y0 <= {a}.y1)", "box_contain": lambda a, b: f"({a}.x0 <= {b}.x0 and {a}.x1 >= {b}.x1 and {a}.y0 <= {b}.y0 and {a}.y1 >= {b}.y1)",
    "circle": lambda p, r: f"named_struct('x', {p}.x, 'y', {p}.y, 'r', cast({r} as double))", "radius": lambda c: f"{c}.r", "diameter": lambda c: f"(2 * {c}.r)", "circle_contain_pt": lambda c, p: f"({_PT(c, p)} <= {c}.r)", "circle_distance": lambda a, b: f"greatest({_PT(a, b)} - {a}.r - {b}.r, 0)", "circle_overlap": lambda a, b: f"({_PT(a, b)} <= {a}.r + {b}.r)",
    "lseg": lambda a, b: f"named_struct('a', {a}, 'b', {b})", "lseg_length": lambda s: _PT(f"{s}.a", f"{s}.b"), "slope": lambda a, b: f"(({b}.y - {a}.y) / ({b}.x - {a}.x))",
}
_NET = ("abbrev", "masklen", "netmask", "network", "broadcast", "hostmask", "host", "family")
NET: dict[str, Build] = {n: (lambda n: lambda x: f"tm_inet_{n}({x})")(n) for n in _NET} | {
    "set_masklen": lambda x, n: f"concat(substring_index({x}, '/', 1), '/', {n})", "network_sub": lambda a, b: f"tm_inet_within({a}, {b}, true)", "network_subeq": lambda a, b: f"tm_inet_within({a}, {b}, false)",
    "network_sup": lambda a, b: f"tm_inet_within({b}, {a}, true)", "network_supeq": lambda a, b: f"tm_inet_within({b}, {a}, false)", "network_overlap": lambda a, b: f"(tm_inet_within({a}, {b}, false) or tm_inet_within({b}, {a}, false))",
}
TEXT: dict[str, Build] = {
    "to_tsvector": lambda *a: f"tm_lexemes({a[-1]})", "to_tsquery": lambda *a: a[-1], "plainto_tsquery": lambda *a: f"array_join(map_keys(tm_lexemes({a[-1]})), ' & ')", "ts_match_vq": lambda v, q: f"tm_ts_match({v}, {q})", "ts_rank": lambda v, q, *n: f"tm_ts_rank({v}, {q})",
    "tsvector_to_array": lambda v: f"map_keys({v})", "strip": lambda v: f"transform_values({v}, (k, p) -> cast(array() as array<int>))", "ts_lexize": lambda d, x: f"array(lower({x}))",
}
MISC: dict[str, Build] = {
    "gen_random_uuid": lambda: "uuid()", "xmlcomment": lambda x: f"concat('<!--', {x}, '-->')", "xmlconcat2": _same("concat"), "xmlagg": lambda x: f"array_join(collect_list({x}), '')", "xpath_exists": lambda p, x, *n: f"xpath_boolean({x}, {p})", "xpath": lambda p, x, *n: f"xpath({x}, {p})",
    "xml_is_well_formed": lambda x: f"tm_xml_ok({x})", "xml_is_well_formed_document": lambda x: f"tm_xml_ok({x})", "every": lambda x: f"bool_and({x})", "range_intersect_agg": lambda r: f"named_struct('lo', max({r}.lo), 'hi', min({r}.hi))", "variance": _same("var_samp"),
}
EXT: dict[str, Build] = {
    "cube": lambda *a: f"transform(array({', '.join(a)}), v -> cast(v as double))" if len(a) > 1 or not a[0].startswith("array(") else f"transform({a[0]}, v -> cast(v as double))", "cube_dim": _same("size"), "cube_ll_coord": lambda c, n: f"try_element_at({c}, {n})", "cube_ur_coord": lambda c, n: f"try_element_at({c}, {n})",
    "cube_distance": lambda a, b: f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> power(coalesce(x, 0) - coalesce(y, 0), 2)), 0D, (s, v) -> s + v))", "hstore": lambda k, v: f"if(typeof({k}) like 'array%', map_from_arrays({k}, {v}), null)" if k.startswith("array(") else f"map({k}, {v})",
    "akeys": _same("map_keys"), "avals": _same("map_values"), "skeys": lambda m: f"explode(map_keys({m}))", "svals": lambda m: f"explode(map_values({m}))", "exist": _same("map_contains_key"), "defined": lambda m, k: f"({m}[{k}] is not null)", "hstore_to_json": _same("to_json"),
    "similarity": lambda a, b: f"tm_similarity({a}, {b})", "show_trgm": lambda a: f"tm_trigrams({a})", "word_similarity": lambda a, b: f"tm_similarity({a}, {b})",
}
# boxes and circles by their bounds: (least x, greatest x, least y, greatest y)
_BOUNDS = {"box": lambda a: (f"{a}.x0", f"{a}.x1", f"{a}.y0", f"{a}.y1"), "circle": lambda a: (f"({a}.x - {a}.r)", f"({a}.x + {a}.r)", f"({a}.y - {a}.r)", f"({a}.y + {a}.r)")}
_PLACE = {
    "left": lambda a, b: f"({a[1]} < {b[0]})", "right": lambda a, b: f"({a[0]} > {b[1]})", "below": lambda a, b: f"({a[3]} < {b[2]})", "above": lambda a, b: f"({a[2]} > {b[3]})",
    "overleft": lambda a, b: f"({a[1]} <= {b[1]})", "overright": lambda a, b: f"({a[0]} >= {b[0]})", "overbelow": lambda a, b: f"({a[3]} <= {b[3]})", "overabove": lambda a, b: f"({a[2]} >= {b[2]})",
}
_AREA = {"box": lambda a: f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))", "circle": lambda a: f"(pi() * {a}.r * {a}.r)"}
_CMPS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def _placed(shape: str, how: str) -> Build:
    return lambda a, b: _PLACE[how](_BOUNDS[shape](a), _BOUNDS[shape](b))


def _sized(shape: str, op: str) -> Build:
    return lambda a, b: f"({_AREA[shape](a)} {op} {_AREA[shape](b)})"


def _shift(shape: str, sign: str) -> Build:
    if shape == "box":
        return lambda a, p: f"named_struct('x1', {a}.x1 {sign} {p}.x, 'y1', {a}.y1 {sign} {p}.y, 'x0', {a}.x0 {sign} {p}.x, 'y0', {a}.y0 {sign} {p}.y)"
    return lambda a, p: f"named_struct('x', {a}.x {sign} {p}.x, 'y', {a}.y {sign} {p}.y, 'r', {a}.r)"


SHAPES: dict[str, Build] = (
    {f"{s}_{h}": _placed(s, h) for s in _BOUNDS for h in _PLACE}
    | {f"{s}_{c}": _sized(s, op) for s in _BOUNDS for c, op in _CMPS.items()}
    | {"box_add": _shift("box", "+"), "box_sub": _shift("box", "-"), "circle_add_pt": _shift("circle", "+"), "circle_sub_pt": _shift("circle", "-")}
    | {
        "box_contained": lambda a, b: f"({b}.x0 <= {a}.x0 and {b}.x1 >= {a}.x1 and {b}.y0 <= {a}.y0 and {b}.y1 >= {a}.y1)", "box_same": lambda a, b: f"({a} = {b})", "circle_same": lambda a, b: f"({a} = {b})", "box_distance": lambda a, b: f"sqrt(power(({a}.x0 + {a}.x1 - {b}.x0 - {b}.x1) / 2, 2) + power(({a}.y0 + {a}.y1 - {b}.y0 - {b}.y1) / 2, 2))",
        "box_intersect": lambda a, b: f"if({GEO['box_overlap'](a, b)}, named_struct('x1', least({a}.x1, {b}.x1), 'y1', least({a}.y1, {b}.y1), 'x0', greatest({a}.x0, {b}.x0), 'y0', greatest({a}.y0, {b}.y0)), null)", "bound_box": lambda a, b: f"named_struct('x1', greatest({a}.x1, {b}.x1), 'y1', greatest({a}.y1, {b}.y1), 'x0', least({a}.x0, {b}.x0), 'y0', least({a}.y0, {b}.y0))",
        "circle_center": lambda c: f"named_struct('x', {c}.x, 'y', {c}.y)", "circle_contain": lambda a, b: f"({_PT(a, b)} <= {a}.r - {b}.r)", "circle_contained": lambda a, b: f"({_PT(a, b)} <= {b}.r - {a}.r)", "pt_contained_circle": lambda p, c: f"({_PT(c, p)} <= {c}.r)", "dist_pc": lambda p, c: f"greatest({_PT(p, c)} - {c}.r, 0)", "dist_cpoint": lambda c, p: f"greatest({_PT(p, c)} - {c}.r, 0)",
        "diagonal": lambda a: f"named_struct('a', named_struct('x', {a}.x1, 'y', {a}.y1), 'b', named_struct('x', {a}.x0, 'y', {a}.y0))", "point_ne": lambda a, b: f"({a}.x <> {b}.x or {a}.y <> {b}.y)", "point_mul": lambda a, b: f"named_struct('x', {a}.x * {b}.x - {a}.y * {b}.y, 'y', {a}.x * {b}.y + {a}.y * {b}.x)",
        "lseg_center": lambda s: f"named_struct('x', ({s}.a.x + {s}.b.x) / 2, 'y', ({s}.a.y + {s}.b.y) / 2)", "lseg_horizontal": lambda s: f"({s}.a.y = {s}.b.y)", "lseg_vertical": lambda s: f"({s}.a.x = {s}.b.x)", "ishorizontal": lambda a, b: f"({a}.y = {b}.y)", "isvertical": lambda a, b: f"({a}.x = {b}.x)",
        "lseg_parallel": lambda s, t: f"(({s}.b.x - {s}.a.x) * ({t}.b.y - {t}.a.y) = ({s}.b.y - {s}.a.y) * ({t}.b.x - {t}.a.x))", "lseg_perp": lambda s, t: f"(({s}.b.x - {s}.a.x) * ({t}.b.x - {t}.a.x) + ({s}.b.y - {s}.a.y) * ({t}.b.y - {t}.a.y) = 0)", "lseg_eq": lambda s, t: f"({s} = {t})", "lseg_ne": lambda s, t: f"({s} <> {t})",
    }
)
# multiranges are arrays of ranges that neither overlap nor touch
_MANY: dict[str, Build] = {
    "multirange_contains_elem": lambda m, x: f"exists({m}, r -> {_in('r', x)})", "elem_contained_by_multirange": lambda x, m: f"exists({m}, r -> {_in('r', x)})", "multirange_contains_range": lambda m, a: f"exists({m}, r -> {_covers('r', a)})", "range_contained_by_multirange": lambda a, m: f"exists({m}, r -> {_covers('r', a)})",
    "multirange_overlaps_range": lambda m, a: f"exists({m}, r -> {_overlap('r', a)})", "range_overlaps_multirange": lambda a, m: f"exists({m}, r -> {_overlap('r', a)})", "multirange_overlaps_multirange": lambda m, n: f"exists({m}, r -> exists({n}, s -> {_overlap('r', 's')}))", "multirange_contains_multirange": lambda m, n: f"forall({n}, s -> exists({m}, r -> {_covers('r', 's')}))",
    "multirange_contained_by_multirange": lambda n, m: f"forall({n}, s -> exists({m}, r -> {_covers('r', 's')}))", "multirange_before_range": lambda m, a: f"forall({m}, r -> coalesce({_before('r', a)}, false))", "multirange_after_range": lambda m, a: f"forall({m}, r -> coalesce({_before(a, 'r')}, false))", "multirange_intersect": lambda m, n: f"array_compact(flatten(transform({m}, r -> transform({n}, s -> {_meet('r', 's')}))))",
    "multirange": lambda a: f"array({a})", "multirange_eq": lambda a, b: f"({a} <=> {b})", "multirange_ne": lambda a, b: f"(not ({a} <=> {b}))",
}
_MANY |= {f"{k}multirange": lambda *a: f"array({', '.join(a)})" for k in ("int4", "int8", "num", "date", "ts", "tstz")}
PLAIN: dict[str, Build] = {
    "array_append": lambda a, x: f"coalesce(array_append({a}, {x}), array({x}))",
    **{f"numeric_{k}": _same(k) for k in ("exp", "ln", "power", "sqrt")}, "numeric_log": lambda b, x: f"log({b}, {x})", "numeric_uminus": lambda x: f"(-({x}))", "numeric_uplus": lambda x: f"({x})", "numeric_div_trunc": lambda a, b: MATH["div"](a, b), "textlen": _same("length"), "bitcat": _same("concat"), "byteacat": _same("concat"),
    "date_pli": lambda a, b: f"date_add({a}, {b})", "date_mii": lambda a, b: f"date_sub({a}, {b})", "integer_pl_date": lambda a, b: f"date_add({b}, {a})", "mul_d_interval": lambda a, b: f"({b} * {a})", "justify_hours": lambda i: i, "justify_days": lambda i: i, "justify_interval": lambda i: i, "get_byte": lambda x, n: f"cast(conv(hex(substring({x}, ({n}) + 1, 1)), 16, 10) as int)",
    "cash_words": lambda x: f"cast({x} as string)", "cash_div_cash": lambda a, b: f"(cast({a} as double) / cast({b} as double))", "xml": _cast("string"), "xmlexists": lambda p, x: f"xpath_boolean({x}, {p})", "xml_is_well_formed_content": lambda x: f"tm_xml_ok(concat('<r>', {x}, '</r>'))", "convert": lambda x, a, b: f"encode(decode({x}, {a}), {b})",
    **{f"jsonb_path_{k}_{t}": _J[f"path_{k}"] for k in ("exists", "match") for t in ("opr", "tz")}, **{f"jsonb_path_{k}_tz": _J[f"path_{k}"] for k in ("query", "query_first", "query_array")}, **{f"{j}_object_agg_unique_strict": _J["object_agg_strict"] for j in ("json", "jsonb")},
    "ts_match_qv": lambda q, v: f"tm_ts_match({v}, {q})", "ts_match_tt": lambda x, q: f"tm_ts_match(tm_lexemes({x}), {q})", "ts_match_tq": lambda x, q: f"tm_ts_match(tm_lexemes({x}), {q})", "ts_rank_cd": lambda v, q, *n: f"tm_ts_rank({v}, {q})", "array_to_tsvector": lambda a: f"tm_lexemes(array_join({a}, ' '))", "tsquery_and": lambda a, b: f"concat('(', {a}, ') & (', {b}, ')')",
    "tsquery_or": lambda a, b: f"concat('(', {a}, ') | (', {b}, ')')", "tsquery_not": lambda a: f"concat('!(', {a}, ')')", "tsquery_phrase": lambda a, b, *n: f"concat({a}, ' <-> ', {b})", "phraseto_tsquery": lambda *a: f"array_join(array_sort(map_keys(tm_lexemes({a[-1]}))), ' <-> ')", "numnode": lambda q: f"regexp_count({q}, '[^\\s&|!()]+|[&|!]')", "querytree": lambda q: q,
    "to_number": lambda x, f: f"to_number({x}, {f})", "ts_delete": lambda v, w: f"map_filter({v}, (k, p) -> k <> {w})",
}
FUNCS: dict[str, Build] = PLAIN | _MANY | SHAPES | EXT | STRINGS | MATH | DATES | ARRAYS | JSON | RANGES | GEO | NET | TEXT | MISC

_TYPED = r"(?:u?int(?:2|24|28|4|42|48|8|82|84)?|float(?:4|48|8|84)|numeric_?|cash_?|text_?|name|bpchar|char|bool|byte?a|date_?|time(?:stamp(?:tz)?|tz)?_?|interval_?|uuid_?|enum_?|array_|record_|jsonb_|bit|oid|macaddr_?|network_)"
_SIGNS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "pl": "+", "mi": "-", "mul": "*", "add": "+", "sub": "-", "mod": "%", "and": "&", "or": "|", "xor": "^", "like": "LIKE", "nlike": "NOT LIKE", "iclike": "ILIKE", "icnlike": "NOT ILIKE", "regexeq": "RLIKE", "regexne": "NOT RLIKE"}
_RULE = re.compile(rf"^{_TYPED}({'|'.join(sorted([*_SIGNS, 'larger', 'smaller', '_larger', '_smaller', 'abs', 'um', 'up', 'not', 'shl', 'shr', 'cmp', 'div', 'inc', 'dec'], key=len, reverse=True))})$")


def rule(name: str) -> str | None:
    """What a type's operator function does, by its name."""
    m = _RULE.match(name[2:] if name.startswith("bt") else name)
    if m:
        return m[1]
    # operators over two types: date_pl_interval, timestamp_eq_date, nameeqtext, text_pattern_lt, cash_mul_int4 ...
    two = r"(?:date|time|timetz|timestamp|timestamptz|interval|cash|flt[48]|int[248]|datetime|datetimetz|timedate|timetzdate)"
    for pattern in (rf"^{two}_(pl|mi|eq|ne|lt|le|gt|ge|cmp|mul|div)_{two}$", rf"^{two}_(pl|mi|mul|div)$", r"^(?:name|text)(eq|ne|lt|le|gt|ge)(?:name|text)$", r"^(?:text|bpchar)_pattern_(ge|gt|le|lt)$", r"^record_image_(eq|ne|lt|le|gt|ge)$", r"^macaddr8_(eq|ne|lt|le|gt|ge|cmp|and|or|not)$", r"^(?:bpchar|name|text)ic(regexeq|regexne)$", r"^bt(?:array|bpchar_pattern|nametext|record|recordimage|text_pattern|textname)(cmp)$", r"^cid(eq)r$"):
        m = re.match(pattern, name)
        if m:
            return "ic" + m[1] if "icregex" in name else m[1]
    m = re.match(r"^(bool|date|float[48]|int[248]|json|jsonb|name|text|uuid|cidr|macaddr8?|interval|numeric|inet|cash|varchar|bpchar|char|xml|time|timestamp|timestamptz)_?in$", name)
    if m:
        return "in:" + m[1]
    if re.match(r"^(hash_?(array|numeric|record|bpchar|char|enum|float[48]|int[248]|macaddr8?|name|text|range|multirange)|(interval|jsonb|timestamp|timetz|time|uuid)_hash)(_?extended)?$", name):
        return "hash64" if name.endswith("extended") else "hash"
    m = re.match(r"^\w+?_?(out|send)$", name)
    return "out" if m and re.match(r"^(any\w*|array|bit|varbit|bool|box|bpchar|bytea|cash|char|cidr|circle|date|enum|float[48]|inet|int[248]|interval|json|jsonb|line|lseg|macaddr8?|name|numeric|path|point|poly|range|multirange|record|text|time(?:stamp)?(?:tz)?|uuid|varchar|void|xml|tsvector|tsquery)_?(out|send)$", name) else None


def _by_rule(what: str, args: list[str]) -> str | None:
    a = [f"({x})" for x in args]
    if what in _SIGNS and len(a) == 2:
        return f"({a[0]} {_SIGNS[what]} {a[1]})"
    if what.startswith("in:"):
        kind = {"bool": "boolean", "float4": "float", "float8": "double", "int2": "smallint", "int4": "int", "int8": "bigint", "date": "date", "time": "time", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "numeric": "decimal(38,10)", "cash": "decimal(19,2)", "interval": "interval day to second"}.get(what[3:], "string")
        return f"cast({args[0]} as {kind})"
    if what in ("icregexeq", "icregexne"):
        return f"({a[0]} {'NOT ' if what.endswith('ne') else ''}RLIKE concat('(?i)', {a[1]}))"
    if what in ("hash", "hash64"):  # the values are Spark's own
        return f"{'hash' if what == 'hash' else 'xxhash64'}({args[0]})"
    if what == "out":
        return f"cast({args[0]} as string)"
    one = {"abs": "abs({0})", "um": "(-{0})", "up": "{0}", "not": "(~{0})", "inc": "({0} + 1)", "dec": "({0} - 1)"}
    two = {"larger": "greatest({0}, {1})", "_larger": "greatest({0}, {1})", "smaller": "least({0}, {1})", "_smaller": "least({0}, {1})", "shl": "shiftleft({0}, {1})", "shr": "shiftright({0}, {1})", "cmp": "cast(sign(if({0} < {1}, -1, if({0} > {1}, 1, 0))) as int)", "div": "({0} / {1})"}
    f = one.get(what) if len(a) == 1 else two.get(what) if len(a) == 2 else None
    return f.format(*a) if f else None


def range_agg(r: str) -> str:
    """The multirange of ranges: sorted, those that overlap or touch made one. Empty and null ranges do not count. For
    keys of very many ranges there is operators.windows.range_agg."""
    rows = f"array_sort(collect_set(if(isnull({r}) or coalesce(({r}).lo > ({r}).hi or (({r}).lo = ({r}).hi and not (({r}).lo_inc and ({r}).hi_inc)), false), null, named_struct('b', ({r}).lo is not null, 'lo', ({r}).lo, 'x', not ({r}).lo_inc, 'r', {r}))))"
    touch = "l.hi is null or s.r.lo is null or s.r.lo < l.hi or (s.r.lo = l.hi and (s.r.lo_inc or l.hi_inc))"
    wide = "named_struct('lo', l.lo, 'hi', if(l.hi is null or s.r.hi is null, null, greatest(l.hi, s.r.hi)), 'lo_inc', l.lo_inc, 'hi_inc', case when l.hi > s.r.hi then l.hi_inc when l.hi < s.r.hi then s.r.hi_inc else l.hi_inc or s.r.hi_inc end)"
    last = "element_at(a, -1)"
    step = f"if(size(a) > 0 and ({touch.replace('l.', last + '.')}), concat(slice(a, 1, size(a) - 1), array({wide.replace('l.', last + '.')})), concat(a, array(s.r)))"
    return f"aggregate({rows}, slice(collect_set({r}), 1, 0), (a, s) -> {step})"


def range_intersect_agg(r: str) -> str:
    """What all ranges share."""
    lo, hi = f"max(if(({r}).lo is null, null, named_struct('v', ({r}).lo, 'x', not ({r}).lo_inc)))", f"min(if(({r}).hi is null, null, named_struct('v', ({r}).hi, 'x', ({r}).hi_inc)))"
    return f"named_struct('lo', ({lo}).v, 'hi', ({hi}).v, 'lo_inc', coalesce(not ({lo}).x, false), 'hi_inc', coalesce(({hi}).x, false))"


def build(name: str, args: list[str]) -> str | None:
    """The expression of a call, or None where Spark's function of that name is meant."""
    if name in FUNCS:
        return FUNCS[name](*args)
    what = rule(name)
    return _by_rule(what, args) if what else None
