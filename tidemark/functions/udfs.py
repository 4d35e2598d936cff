"""Vectorized UDFs for functions that no built-in expresses, registered under the prefix tm_. Null in, null out."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import math
import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _rows(f: Callable, *cols: pd.Series) -> pd.Series:
    """f row by row within an Arrow batch; a null argument gives null, and so does a member that is not there. An argument
    that f cannot read is an error."""

    def one(*a: object) -> object:
        if any(x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) for x in a):
            return None
        try:
            return f(*a)
        except (KeyError, TypeError, IndexError):
            return None

    return pd.Series([one(*a) for a in zip(*cols)], dtype=object)


def _path(p: object) -> list[str]:
    return [x.strip().strip('"') for x in p.strip("{}").split(",") if x.strip()] if isinstance(p, str) else [str(x) for x in p]


def dumps(v: object) -> str:
    return json.dumps(v, ensure_ascii=False)


def _step(doc: object, k: str) -> object:
    return doc[int(k)] if isinstance(doc, list) else doc[k]


def json_set(x: str, p: object, v: str, create: bool, insert: bool = False) -> str:
    doc, keys = json.loads(x), _path(p)
    at = doc
    try:
        for k in keys[:-1]:
            at = _step(at, k)
    except (KeyError, IndexError, TypeError):
        return dumps(doc)
    k, new = keys[-1], json.loads(v)
    if isinstance(at, list):
        i = int(k)
        if insert:
            at.insert(i + bool(create) if i >= 0 else len(at) + i + bool(create), new)
        elif -len(at) <= i < len(at):
            at[i] = new
        elif create:
            at.insert(0 if i < 0 else len(at), new)
    elif isinstance(at, dict):
        if insert and k in at:
            raise ValueError("the key exists")
        if k in at or create or insert:
            at[k] = new
    return dumps(doc)


def contains(a: object, b: object) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(contains(x, y) for x in a) for y in b)
    return (b in a if isinstance(a, list) else a == b) and not isinstance(a, dict)


def _strip(v: object) -> object:
    if isinstance(v, dict):
        return {k: _strip(x) for k, x in v.items() if x is not None}
    return [_strip(x) for x in v] if isinstance(v, list) else v


def _delete(x: str, k: str) -> str:
    d = json.loads(x)
    if isinstance(d, dict):
        d.pop(k, None)
    elif re.fullmatch(r"-?\d+", k):
        del d[int(k)]
    else:
        d = [y for y in d if y != k]
    return dumps(d)


def _delete_path(x: str, p: object) -> str:
    d, keys = json.loads(x), _path(p)
    at = d
    for k in keys[:-1]:
        at = _step(at, k)
    at.pop(int(keys[-1]) if isinstance(at, list) else keys[-1])
    return dumps(d)


def _rank(v: object) -> tuple:
    kind = {type(None): 0, str: 1, int: 2, float: 2, bool: 3, list: 4, dict: 5}[type(v)]
    if isinstance(v, list):
        return (kind, len(v), [_rank(x) for x in v])
    if isinstance(v, dict):
        return (kind, len(v), [(k, _rank(x)) for k, x in sorted(v.items())])
    return (kind, 0 if v is None else v)


def json_path(x: str, path: str) -> list[str]:
    """A subset of SQL/JSON paths: keys, .*, [n], [*], [a to b], last, and one filter ?(@.key op value)."""
    vals, rest = [json.loads(x)], path.strip()
    rest = re.sub(r"^(strict|lax)\s+", "", rest)[1:]
    while rest:
        if m := re.match(r'\.\s*(?:"([^"]*)"|(\*)|(\w+)(?!\())', rest):
            key, out = m[1] if m[1] is not None else m[3], []
            for v in [y for v in vals for y in (v if isinstance(v, list) else [v])]:
                if isinstance(v, dict):
                    out += list(v.values()) if m[2] else [v[key]] if key in v else []
            vals = out
        elif m := re.match(r"\[\s*(\*|last|\d+)(?:\s+to\s+(last|\d+))?\s*\]", rest):
            out = []
            for v in vals:
                v = v if isinstance(v, list) else [v]
                n = lambda t, v=v: len(v) - 1 if t == "last" else int(t)
                out += v if m[1] == "*" else v[n(m[1]) : n(m[2] or m[1]) + 1]
            vals = out
        elif m := re.match(r"\s*\?\s*\(\s*@((?:\.\w+)*)\s*(==|!=|<>|<=|>=|<|>)\s*(\"[^\"]*\"|-?[\d.]+|true|false|null)\s*\)", rest):
            want, out = json.loads(m[3]), []
            for v in [y for v in vals for y in (v if isinstance(v, list) else [v])]:
                got = v
                for k in [k for k in m[1].split(".") if k]:
                    got = got.get(k) if isinstance(got, dict) else None
                if m[2] in ("==", "!=", "<>"):
                    ok = (got == want) == (m[2] == "==")
                else:
                    ok = type(got) in (int, float, str) and isinstance(got, str) == isinstance(want, str) and {"<": got < want, ">": got > want, "<=": got <= want, ">=": got >= want}[m[2]]
                out += [v] if ok else []
            vals = out
        elif m := re.match(r"\.(size|type|double|floor|ceiling|abs)\(\)", rest):
            f = {"size": lambda v: len(v) if isinstance(v, list) else 1, "type": json_typeof, "double": float, "floor": math.floor, "ceiling": math.ceil, "abs": abs}[m[1]]
            vals = [f(v) for v in vals]
        else:
            raise ValueError(f"the path {rest!r} is not supported")
        rest = rest[m.end() :]
    return [dumps(v) for v in vals]


def json_typeof(v: object) -> str:
    return {type(None): "null", str: "string", int: "number", float: "number", bool: "boolean", list: "array", dict: "object"}[type(v)]


def lexemes(t: str) -> dict[str, list[int]]:
    """Words in lower case with their places (the `simple` configuration)."""
    out: dict[str, list[int]] = {}
    for i, w in enumerate(re.findall(r"\w+", t.lower()), 1):
        out.setdefault(w, []).append(i)
    return out


def ts_match(v: dict, q: str) -> bool:
    """A tsquery of words, & | ! and parentheses against a vector."""
    have = dict(v)
    toks = re.findall(r"<->|[&|!()]|[^\s&|!()<>]+", q.lower())

    def either() -> bool:
        x = both()
        while toks and toks[0] == "|":
            toks.pop(0)
            x = both() or x
        return x

    def both() -> bool:
        x = unit()
        while toks and toks[0] in ("&", "<->"):
            toks.pop(0)
            x = unit() and x
        return x

    def unit() -> bool:
        t = toks.pop(0)
        if t == "!":
            return not unit()
        if t == "(":
            x = either()
            toks.pop(0)
            return x
        t = t.strip("'")
        return any(w.startswith(t[:-2]) for w in have) if t.endswith(":*") else t in have

    return either()


def _parse_ident(x: str) -> list[str]:
    return [a if a else b.lower() for a, b in re.findall(r'"([^"]+)"|(\w+)', x)]


def _ip(x: str):
    return ipaddress.ip_interface(x)


def _age(a: pd.Timestamp, b: pd.Timestamp) -> str:
    """Years, months, days and time between two timestamps, in PostgreSQL's form."""
    sign = "" if a >= b else "-"
    a, b = max(a, b), min(a, b)
    m = (a.year - b.year) * 12 + a.month - b.month
    while b + pd.DateOffset(months=m) > a:
        m -= 1
    rest = a - (b + pd.DateOffset(months=m))
    parts = [(m // 12, "year"), (m % 12, "mon"), (rest.days, "day")]
    out = [f"{sign}{n} {u}{'s' if n != 1 else ''}" for n, u in parts if n]
    s = rest.seconds
    if s or rest.microseconds or not out:
        out.append(f"{sign}{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}" + (f".{rest.microseconds:06d}".rstrip("0") if rest.microseconds else ""))
    return " ".join(out)


def _similar(p: str) -> str:
    return "^(?:" + re.sub(r"[.^$]", lambda m: "\\" + m[0], p).replace("%", ".*").replace("_", ".") + ")$"


def trigrams(x: str) -> list[str]:
    out = set()
    for w in re.findall(r"\w+", x.lower()):
        p = f"  {w} "
        out |= {p[i : i + 3] for i in range(len(p) - 2)}
    return sorted(out)


def similarity(a: str, b: str) -> float:
    x, y = set(trigrams(a)), set(trigrams(b))
    return len(x & y) / len(x | y) if x or y else 0.0


# name: (result type, function of the values of one row)
ROW = {
    "sha224": ("string", lambda x: hashlib.sha224(x if isinstance(x, bytes) else x.encode()).hexdigest()),
    "normalize": ("string", lambda x: unicodedata.normalize("NFC", x)), "is_normalized": ("boolean", lambda x: unicodedata.is_normalized("NFC", x)),
    "to_ascii": ("string", lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()), "unistr": ("string", lambda x: re.sub(r"\\(?:u([0-9A-Fa-f]{4})|\+([0-9A-Fa-f]{6})|([0-9A-Fa-f]{4}))", lambda m: chr(int(m[1] or m[2] or m[3], 16)), x)),
    "parse_ident": ("array<string>", _parse_ident), "similar": ("string", _similar),
    "groups": ("array<string>", lambda x, p: (lambda m: list(m.groups()) or [m[0]])(re.search(p, x))), "all_groups": ("array<array<string>>", lambda x, p: [list(m.groups()) or [m[0]] for m in re.finditer(p, x)]),
    "regexp_first": ("string", lambda x, p, r: re.sub(p, r, x, count=1)),
    "json_items": ("array<string>", lambda x: [dumps(v) for v in json.loads(x)]), "json_strip": ("string", lambda x: dumps(_strip(json.loads(x)))), "json_typeof": ("string", lambda x: json_typeof(json.loads(x))), "json_pretty": ("string", lambda x: json.dumps(json.loads(x), indent=4, ensure_ascii=False)),
    "json_set": ("string", json_set), "json_insert": ("string", lambda x, p, v, a: json_set(x, p, v, a, True)), "json_concat": ("string", lambda a, b: dumps((lambda u, w: {**u, **w} if isinstance(u, dict) and isinstance(w, dict) else (u if isinstance(u, list) else [u]) + (w if isinstance(w, list) else [w]))(json.loads(a), json.loads(b)))),
    "json_contains": ("boolean", lambda a, b: contains(json.loads(a), json.loads(b))), "json_delete": ("string", _delete), "json_delete_path": ("string", _delete_path), "json_cmp": ("int", lambda a, b: (lambda u, w: (u > w) - (u < w))(_rank(json.loads(a)), _rank(json.loads(b)))),
    "json_path": ("array<string>", json_path), "lexemes": ("map<string,array<int>>", lexemes), "ts_match": ("boolean", ts_match), "ts_rank": ("float", lambda v, q: sum(len(p) for w, p in dict(v).items() if w in re.findall(r"\w+", q.lower())) / max(1, len(dict(v)))),
    "trigrams": ("array<string>", trigrams), "similarity": ("float", similarity),
    "xml_ok": ("boolean", lambda x: _xml_ok(x)), "age": ("string", _age),
    "inet_abbrev": ("string", lambda x: x), "inet_masklen": ("int", lambda x: _ip(x).network.prefixlen), "inet_netmask": ("string", lambda x: str(_ip(x).netmask)), "inet_network": ("string", lambda x: str(_ip(x).network)), "inet_broadcast": ("string", lambda x: f"{_ip(x).network.broadcast_address}/{_ip(x).network.prefixlen}"),
    "inet_hostmask": ("string", lambda x: str(_ip(x).hostmask)), "inet_host": ("string", lambda x: str(_ip(x).ip)), "inet_family": ("int", lambda x: _ip(x).version),
    "inet_within": ("boolean", lambda a, b, s: _ip(a).version == _ip(b).version and _ip(a).network.subnet_of(_ip(b).network) and not (s and _ip(a).network == _ip(b).network)),
}


def _xml_ok(x: str) -> bool:
    try:
        ET.fromstring(x)
    except ET.ParseError:
        return False
    return True


def _gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    ok = a.notna() & b.notna()
    out = pd.Series(pd.array([None] * len(a), dtype="Int64"))
    out[ok] = np.gcd(a[ok].astype("int64"), b[ok].astype("int64"))
    return out


def register(spark: SparkSession) -> None:
    """Make the tm_ functions known to the session."""
    n_args = {"regexp_first": 3, "json_set": 4, "json_insert": 4, "inet_within": 3} | dict.fromkeys(("groups", "all_groups", "json_concat", "json_contains", "json_delete", "json_delete_path", "json_cmp", "json_path", "ts_match", "ts_rank", "age", "similarity"), 2)
    for name, (kind, f) in ROW.items():
        n = n_args.get(name, 1)
        S = pd.Series
        if n == 1:
            g = (lambda f: lambda a: _rows(f, a))(f)
        elif n == 2:
            g = (lambda f: lambda a, b: _rows(f, a, b))(f)
        elif n == 3:
            g = (lambda f: lambda a, b, c: _rows(f, a, b, c))(f)
        else:
            g = (lambda f: lambda a, b, c, d: _rows(f, a, b, c, d))(f)
        g.__annotations__ = dict.fromkeys("abcd"[:n], S) | {"return": S}
        spark.udf.register(f"tm_{name}", F.pandas_udf(g, kind))

    def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
        return _gcd(a, b)

    def erf(a: pd.Series) -> pd.Series:
        return _rows(math.erf, a).astype("float64")

    for name, kind, f in (("gcd", "bigint", gcd), ("erf", "double", erf)):
        f.__annotations__ = {k: pd.Series for k in f.__annotations__}
        spark.udf.register(f"tm_{name}", F.pandas_udf(f, kind))
