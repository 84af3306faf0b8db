"""Identifiers as Column expressions: splitting, normalising, ids, candidate names, data types.

Invalid input gives null; ``strict`` raises on the executor instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A part without the spaces around it. Possessive: Java's regex recurses on other repeated groups, once per repeat.
_QUOTED = r'"[^"]*+"|`[^`]*+`|\[[^\]]*+\]'
_WORD = rf'(?:{_QUOTED}|[^ ."`\[\]]++)++'
_PART = rf"{_WORD}(?: ++{_WORD})*+"
_WHOLE = rf"^ *+{_PART} *+(?:\. *+{_PART} *+)*+$"

# Raw data type -> canonical data type, for every dialect and then for some.
TYPES = {
    "": {
        "boolean": "boolean", "bool": "boolean", "int": "int", "integer": "int", "int4": "int", "bigint": "bigint", "int8": "bigint", "smallint": "smallint", "int2": "smallint",
        "float": "float", "real": "float", "float4": "float", "double": "double", "double precision": "double", "float8": "double", "decimal": "decimal", "numeric": "decimal", "number": "decimal",
        "varchar": "varchar", "character varying": "varchar", "char": "varchar", "character": "varchar", "string": "varchar", "text": "text", "date": "date", "datetime": "timestamp",
        "timestamp": "timestamp", "timestamp without time zone": "timestamp", "timestamptz": "timestamptz", "timestamp with time zone": "timestamptz", "time": "time", "json": "json", "jsonb": "json", "uuid": "uuid",
    },
    "snowflake": {"variant": "variant", "object": "object", "array": "array", "timestamp_ntz": "timestamp", "timestamp_ltz": "timestamptz", "timestamp_tz": "timestamptz"},
    "bigquery": {"int64": "bigint", "float64": "double", "bytes": "binary"},
}


def _given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_identifier(name: Column, strict: bool = False) -> Column:
    """Parts at dots outside quotes, trimmed; null for an empty part or an open quote."""
    parts = F.regexp_extract_all(name, F.lit(f"({_PART})"), F.lit(1))
    bad = F.raise_error(F.concat(F.lit("invalid identifier: "), F.coalesce(name, F.lit("null")))) if strict else F.lit(None)
    return F.when(name.rlike(_WHOLE), parts).otherwise(bad)


def _bare(part: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(part), r'^(?:"(.*)"|`(.*)`|\[(.*)\])$', "$1$2$3")))


def _named(bare: Column) -> Column:
    return F.when((bare != "") & (bare != "*"), bare)


def normalize_part(part: Column) -> Column:
    """Trimmed, without one pair of quotes, trimmed, lower case; null if empty or a star."""
    return _given(_bare(part), _named)


def _normal_parts(name: Column, strict: bool = False) -> Column:
    return F.transform(F.transform(split_identifier(name, strict), _bare), _named)


def normalize(name: Column, strict: bool = False) -> Column:
    return _given(_normal_parts(name, strict), lambda parts: F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ".")))


def make_id(kind: str, name: Column) -> Column:
    """``kind:normalised.name``."""
    return F.concat(F.lit(f"{kind}:"), normalize(name))


def column_id(dataset: Column, column: Column) -> Column:
    return F.concat(F.lit("column:"), normalize(dataset), F.lit("."), normalize_part(column))


def leaf_name(name: Column) -> Column:
    return F.element_at(split_identifier(name), -1)


def schema_name(name: Column) -> Column:
    return _given(split_identifier(name), lambda parts: F.when(F.size(parts) > 1, F.element_at(parts, -2)))


def dataset_of(location: Column) -> Column:
    """The file name up to its first dot."""
    return F.substring_index(F.substring_index(location, "/", -1), ".", 1)


def column_selection(id_: Column) -> Column:
    """(dataset, column) of a column id."""
    rest = F.regexp_extract(id_, r"^column:(.+)$", 1)
    return F.when(id_.startswith("column:") & rest.contains("."), F.struct(F.regexp_extract(rest, r"^(.*)\.[^.]+$", 1).alias("dataset"), F.substring_index(rest, ".", -1).alias("column")))


def fqn_candidates(name: Column) -> Column:
    """db.schema.table, schema.table, table: in this order, without repeats; null for more than three parts."""

    def candidates(parts: Column) -> Column:
        n = F.size(parts)
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))
        return F.when((n >= 1) & (n <= 3), F.array_distinct(each))

    return _given(_normal_parts(name), candidates)


def lookup_keys(name: Column, *others: Column) -> Column:
    """All of the name, its last three and last two parts, and further names; never the bare leaf of a longer name."""

    def keys(parts: Column) -> Column:
        tail = lambda k: F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), "."))
        return F.array(F.array_join(parts, "."), tail(3), tail(2), *[normalize(o) for o in others])

    return F.array_distinct(F.filter(_given(F.split(normalize(name), r"\."), keys), lambda k: k.isNotNull()))


def apply_aliases(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """``name`` normalised and replaced by its alias, if ``aliases`` (alias, target) has one."""
    own = df.withColumn(name, normalize(F.col(name)))
    table = aliases.select(normalize(F.col("alias")).alias("__alias"), normalize(F.col("target")).alias("__target")).dropDuplicates(["__alias"])
    joined = own.join(table, F.col(name) == F.col("__alias"), "left")
    return joined.withColumn(name, F.coalesce("__target", name)).drop("__alias", "__target")


def binding_key(binding: Column) -> Column:
    """The five parts, null as empty."""
    fields = ("warehouse", "database", "schema", "table", "column")
    return F.struct(*[F.coalesce(binding[f], F.lit("")).alias(f) for f in fields])


def canonical_type(raw: Column, dialect: str = "") -> Column:
    """The canonical data type without precision; null if the dialect doesn't have it."""
    known = TYPES[""] | TYPES.get(dialect, {})
    base = F.trim(F.substring_index(F.lower(F.trim(raw)), "(", 1))
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[base]
