"""Annotation documents as JSON: a strict reader and the writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.operators.validate import document_errors
from pagewright.schema import ANNOTATION, BOUNDS, ENUMS, NOT_NULL, REQUIRED, SCHEMA_VERSION


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, json: one whole file a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def _levels(schema: T.StructType, path: str = "") -> list[tuple[str, T.StructType, bool]]:
    """(path, struct, whether it stands in an array) of every object that the schema knows."""
    out = [(path, schema, False)]
    for f in schema:
        at = f"{path}.{f.name}" if path else f.name
        kind, many = f.dataType, False
        while isinstance(kind, T.ArrayType):
            kind, many = kind.elementType, True
        if isinstance(kind, T.StructType):
            below = _levels(kind, at)
            out += [(p, s, m or many) for p, s, m in below]
    return out


def _below(objects: Column, name: str) -> Column:
    """The objects that a member of some JSON objects holds, alone or in an array."""
    values = F.transform(objects, lambda j: F.get_json_object(j, f"$.{name}"))
    spread = F.transform(values, lambda v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v)))
    return F.filter(F.flatten(spread), lambda v: v.isNotNull())


def _objects(json: Column, path: str) -> Column:
    """array<string> of the JSON objects at a dotted path, through arrays."""
    found = F.array(json)
    for name in path.split(".") if path else []:
        found = _below(found, name)
    return found


def _level_errors(json: Column, path: str, known: list[str], required: list[str]) -> Column:
    where = f"{path}." if path else ""
    texts = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    keys = F.transform(_objects(json, path), lambda j: F.coalesce(F.json_object_keys(j), texts([])))
    unknown = F.array_distinct(F.flatten(F.transform(keys, lambda k: F.array_except(k, texts(known)))))
    missing = F.array_distinct(F.flatten(F.transform(keys, lambda k: F.array_except(texts(required), k))))
    return F.concat(
        F.transform(unknown, lambda n: F.concat(F.lit(f"unknown member {where}"), n)),
        F.transform(missing, lambda n: F.concat(F.lit(f"missing member {where}"), n)),
    )


#: What a JSON value of each type is called as a variant.
_KINDS = {
    T.StringType: ("text", "STRING"), T.LongType: ("a whole number", "BIGINT"), T.FloatType: ("a number", "(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
    T.BooleanType: ("true or false", "BOOLEAN"), T.StructType: ("an object", "OBJECT"),
}


def _kind(kind: T.DataType) -> tuple[str, str]:
    """What a member must be, and the pattern of its variant's schema."""
    if isinstance(kind, T.ArrayType):
        what, pattern = _kind(kind.elementType)
        return f"an array, each {what}", f"ARRAY<({pattern}|VOID)"
    return _KINDS[type(kind)]


def _member_error(member: Column, name: str, kind: T.DataType, required: bool) -> Column:
    """The error of a member's value, or null. A missing member is left to another rule."""
    what, pattern = _kind(kind)
    schema = F.schema_of_variant(member)
    wrong = F.when(schema == "VOID", F.lit(required or name in NOT_NULL)).otherwise(~schema.rlike(f"^{pattern}"))
    error = F.when(wrong, f"{name} must be {what}")
    if name in ENUMS:
        error = error.when(~F.try_variant_get(member, "$", "string").isin(ENUMS[name]), f"{name} is none of {', '.join(ENUMS[name])}")
    if name in BOUNDS:
        error = error.when(~F.try_variant_get(member, "$", "long").between(0, BOUNDS[name]), f"{name} is out of range")
    return error


def _value_errors(json: Column, path: str, schema: T.StructType) -> Column:
    """Members of a wrong type, outside their set of values or out of range, at one level."""
    names = {f.name: f"{path}.{f.name}" if path else f.name for f in schema}
    required = REQUIRED.get(path, [])

    def of(members: Column) -> Column:
        return F.array_compact(F.array(*[_member_error(F.element_at(members, f.name), names[f.name], f.dataType, f.name in required) for f in schema]))

    parsed = F.transform(_objects(json, path), lambda j: F.from_json(j, "map<string, variant>"))
    return F.array_distinct(F.flatten(F.transform(F.array_compact(parsed), of)))


def strict_errors(json: Column) -> Column:
    """Members that the format does not know, required ones that are missing, and values of a wrong type, outside a
    closed set or out of range, at every level."""
    levels = _levels(ANNOTATION)
    members = [_level_errors(json, path, schema.names, REQUIRED.get(path, [])) for path, schema, _ in levels]
    return F.concat(*members, *[_value_errors(json, path, schema) for path, schema, _ in levels])


def text_error(json: Column) -> Column:
    """Why a text is not one JSON object by the grammar, or null: no object, text after it, or a member repeated at any level.

    A parser stops where a value ends, so the text is parsed within a pair of square brackets and within an object: an
    opening or closing bracket too many breaks one of the two, and a second value makes the array longer.
    """
    within = lambda a, b: F.concat(F.lit(a), json, F.lit(b))
    listed, held = within("[", "]"), within('{"a":', "}")
    single = F.size(F.try_variant_get(F.try_parse_json(listed), "$", "array<variant>")) == 1
    strict = F.coalesce(single & F.try_parse_json(held).isNotNull(), F.lit(False))
    plain = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    whole = (F.size(F.from_json(listed, "array<string>", plain)) == 1) & (F.size(F.from_json(held, "map<string, string>", plain)) == 1)
    surrogate = json.rlike(_HIGH) | json.rlike(_LOW)
    return (
        F.when(F.json_object_keys(json).isNull(), "not a JSON object")
        .when(~strict & F.try_parse_json(json).isNotNull(), "text after the JSON object")
        .when(~strict & F.coalesce(whole, F.lit(False)), "a member is repeated")
        .when(~strict, "not a JSON object")
        .when(surrogate, "half of a surrogate pair")
    )


#: Escapes of one half of a surrogate pair without the other.
_HIGH = r"(?<!\\)(\\\\)*\\u[dD][89aAbB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])"
_LOW = r"(?<!\\)(?<!\\u[dD][89aAbB][0-9a-fA-F]{2})(\\\\)*\\u[dD][c-fC-F][0-9a-fA-F]{2}"


def parse_documents(rows: DataFrame, json: str = "json", validate: bool = True, version: str = SCHEMA_VERSION, first_only: bool = False) -> DataFrame:
    """rows with doc (null if the text is not one JSON object) and errors (all of them, or the first; empty for a good document).

    A text that the grammar refuses has that error alone: what its members say is not known.
    """
    broken = text_error(F.col(json))
    parsed = rows.withColumn("doc", F.when(broken.isNull(), F.from_json(json, ANNOTATION, {"mode": "PERMISSIVE"})))
    rules = document_errors(F.col("doc"), version) if validate else F.array().cast("array<string>")
    errors = F.when(broken.isNotNull(), F.array(broken)).otherwise(F.concat(strict_errors(F.col(json)), rules))
    return parsed.withColumn("errors", F.slice(errors, 1, 1) if first_only else errors)


def _without_empty(doc: Column) -> Column:
    """Empty arrays that the format omits, and a false `sensitive`, as nulls (which to_json leaves out)."""
    empty = lambda a: F.when(F.size(a) > 0, a)
    lines = F.transform(
        doc["lines"], lambda n: n.withField("alternatives", empty(n["alternatives"])).withField("flags", empty(n["flags"]))
    )
    meta = doc["metadata"]
    meta = meta.withField("tags", empty(meta["tags"])).withField("sensitive", F.when(meta["sensitive"], True))
    return doc.withField("lines", lines).withField("metadata", meta)


def document_json(doc: Column, pretty: bool = False) -> Column:
    return F.to_json(_without_empty(doc), {"pretty": "true"} if pretty else {})


def write_documents(docs: DataFrame, path: str, kind: str = "json", doc: str = "doc") -> None:
    """Text, JSON or pretty JSON files in a folder, which must be new: inputs are never overwritten."""
    kinds = {"text": F.col(doc)["text"], "json": document_json(F.col(doc)), "json_pretty": document_json(F.col(doc), True)}
    if kind not in kinds:
        raise ValueError(f"kind must be one of {sorted(kinds)}, not {kind!r}")
    docs.select(kinds[kind].alias("value")).write.mode("errorifexists").text(path)


def write_json(rows: DataFrame, path: str, pretty: bool = False) -> None:
    """Each row as a JSON object, null members left out, in a folder that must be new."""
    rows.select(F.to_json(F.struct("*"), {"pretty": "true"} if pretty else {}).alias("value")).write.mode("errorifexists").text(path)
