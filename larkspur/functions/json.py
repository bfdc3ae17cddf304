"""JSON as text and as variants."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def get_text(doc, *path) -> Column:
    """``doc #>> path``: keys and 0-based places."""
    where = "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)
    return F.get_json_object(_c(doc), where)


def is_json(doc, kind: str = "value") -> Column:
    """``IS JSON [VALUE | OBJECT | ARRAY | SCALAR]``; null stays null."""
    doc = _c(doc)
    v = F.try_parse_json(doc)
    ok = v.isNotNull()
    shape = F.schema_of_variant(v)
    more = {"value": F.lit(True), "object": shape.startswith("OBJECT"), "array": shape.startswith("ARRAY"), "scalar": ~(shape.startswith("OBJECT") | shape.startswith("ARRAY"))}[kind]
    return F.when(doc.isNotNull(), F.coalesce(ok & more, F.lit(False)))


def type_of(doc) -> Column:
    """``jsonb_typeof``."""
    shape = F.schema_of_variant(F.try_parse_json(_c(doc)))
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").when(shape.isNotNull(), "number")


def keys(doc) -> Column:
    return F.json_object_keys(_c(doc))


def build_object(absent_on_null: bool = False, **values) -> Column:
    return F.to_json(F.struct(*(_c(v).alias(k) for k, v in values.items())), {"ignoreNullFields": str(absent_on_null).lower()})


def build_array(*values) -> Column:
    return F.to_json(F.array(*map(_c, values)))


def object_agg(key, value) -> Column:
    """``json_object_agg`` with the keys in order; a key's last value in value order stays."""
    pairs = F.array_sort(F.collect_list(F.struct(_c(key).alias("key"), _c(value).alias("value"))))
    return F.to_json(F.map_from_entries(pairs))


def array_agg(value, *order) -> Column:
    from . import arrays

    return F.to_json(arrays.collect(value, *order))


def _udf(fn, kind=K.StringType()):
    def run(doc, *args):
        if doc is None:
            return None
        try:
            return fn(json.loads(doc), *args)
        except ValueError:
            return None

    return F.udf(run, kind, useArrow=True)


def _at(value, path):
    for p in path:
        if isinstance(value, list):
            i = int(p)
            value = value[i] if -len(value) <= i < len(value) else None
        elif isinstance(value, dict):
            value = value.get(p)
        else:
            return None
    return value


def _set(value, path, new, create=True):
    if not path:
        return new
    head, rest = path[0], path[1:]
    if isinstance(value, dict):
        if head in value or (create and not rest):
            value[head] = _set(value.get(head), rest, new, create)
    elif isinstance(value, list):
        i = int(head)
        if -len(value) <= i < len(value):
            value[i] = _set(value[i], rest, new, create)
        elif create and not rest:
            value.insert(len(value) if i > 0 else 0, new)
    return value


def _drop(value, path):
    if isinstance(value, dict) and path:
        if len(path) == 1:
            value.pop(path[0], None)
        elif path[0] in value:
            _drop(value[path[0]], path[1:])
    elif isinstance(value, list) and path:
        i = int(path[0])
        if -len(value) <= i < len(value):
            if len(path) == 1:
                del value[i]
            else:
                _drop(value[i], path[1:])
    return value


def _bare(value):
    if isinstance(value, dict):
        return {k: _bare(v) for k, v in value.items() if v is not None}
    return [_bare(v) for v in value] if isinstance(value, list) else value


def _holds(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _holds(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(_holds(x, y) for x in a) for y in b) if isinstance(b, list) else any(x == b for x in a)
    return a == b


jsonb_pretty = _udf(lambda d: json.dumps(d, indent=4, ensure_ascii=False))
jsonb_set = _udf(lambda d, path, new: json.dumps(_set(d, list(path), json.loads(new)), ensure_ascii=False))
jsonb_delete_path = _udf(lambda d, path: json.dumps(_drop(d, list(path)), ensure_ascii=False))
jsonb_strip_nulls = _udf(lambda d: json.dumps(_bare(d), ensure_ascii=False))
jsonb_contains = _udf(lambda d, other: _holds(d, json.loads(other)), K.BooleanType())
jsonb_concat = _udf(lambda d, other: json.dumps(d | json.loads(other) if isinstance(d, dict) else d + json.loads(other), ensure_ascii=False))


def has_unique_keys(doc) -> Column:
    @F.udf(K.BooleanType(), useArrow=True)
    def run(text):
        if text is None:
            return None
        seen = []
        try:
            json.loads(text, object_pairs_hook=lambda pairs: seen.append(len({k for k, _ in pairs}) == len(pairs)))
        except ValueError:
            return False
        return all(seen)

    return run(_c(doc))


def path_query(doc, path: str) -> Column:
    """``jsonb_path_query_first`` for paths of keys, places and ``[*]`` without filters."""
    return F.try_variant_get(F.try_parse_json(_c(doc)), path, "string")


def object_agg_strict(key, value) -> Column:
    """``json_object_agg_strict``: pairs with a null value are left out."""
    pair = F.when(_c(value).isNotNull(), F.struct(_c(key).alias("key"), _c(value).alias("value")))
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(pair))))


def object_agg_unique(key, value) -> Column:
    """``json_object_agg_unique``: a key that comes twice is an error."""
    pairs = F.array_sort(F.collect_list(F.struct(_c(key).alias("key"), _c(value).alias("value"))))
    same = F.size(F.array_distinct(F.transform(pairs, lambda p: p["key"]))) == F.size(pairs)
    return F.when(same, F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"})).otherwise(F.raise_error(F.lit("duplicate JSON object key value")))


_WORD = r'("(?:[^"\\]|\\.)*"|[^\s,=>"]+)'


def hstore(text) -> Column:
    """``a=>1, "b c"=>NULL`` as a map of strings."""

    def bare(s: Column) -> Column:
        inner = F.regexp_replace(F.substring(s, F.lit(2), F.length(s) - 2), r"\\(.)", "$1")
        return F.when(F.startswith(s, F.lit('"')), inner).otherwise(s)

    keys, values = (F.regexp_extract_all(_c(text), F.lit(rf"{_WORD}\s*=>\s*{_WORD}"), F.lit(i)) for i in (1, 2))
    return F.map_from_arrays(F.transform(keys, bare), F.transform(values, lambda v: F.when(F.upper(v) != "NULL", bare(v))))


def _quoted(s: Column) -> Column:
    """A string as a JSON string."""
    one = F.to_json(F.array(s))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def hstore_to_json(h, loose: bool = False) -> Column:
    """A map of strings as JSON, keys in order; ``loose`` writes numbers and truth values bare."""

    def shown(v: Column) -> Column:
        out = F.when(v.isNull(), "null")
        if loose:
            out = out.when(v == "t", "true").when(v == "f", "false").when(v.rlike(r"^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?$"), v)
        return out.otherwise(_quoted(v))

    cells = F.transform(F.array_sort(F.map_entries(_c(h))), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), shown(e["value"])))
    return F.concat(F.lit("{"), F.array_join(cells, ","), F.lit("}"))
