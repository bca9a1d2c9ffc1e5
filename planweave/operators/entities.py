"""Entity containers of rule clauses: null, object, array, wrapped object or string holding JSON, to one list of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Members an entity itself may have; an object with one other member is a wrapper.
MEMBERS = ["subject", "relation", "object", "property", "comparator", "value", "unit", "condition", "conditions"]


def json_list(text: Column) -> Column:
    """JSON text of an array as its members' texts, of an object as that one; null otherwise."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith("{"), F.array(text))


def with_json_text(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the JSON text of a column: trimmed, taken out of the strings that hold it, however many, null if cut off.

    Each step is a column of its own, so that nothing is parsed twice.  A string within a string needs escapes for
    all it holds, so n strings take more than n * n characters, which bounds the steps by the text's own length.
    """
    unwrapped = lambda t, _: F.when(t.startswith('"'), F.trim(F.get_json_object(F.concat(F.lit('{"a":'), t, F.lit("}")), "$.a"))).otherwise(t)
    df = df.withColumn(name, F.trim(F.col(column)))
    steps = F.sequence(F.lit(0), F.sqrt(F.length(name)).cast("int") + 1)
    df = df.withColumn(name, F.when(F.col(name).startswith('"'), F.aggregate(steps, F.col(name), unwrapped)).otherwise(F.col(name)))
    # As a member, since the parser alone passes over what follows a complete value.
    return df.withColumn(name, F.when(F.try_parse_json(F.concat(F.lit('{"a":'), F.col(name), F.lit("}"))).isNotNull(), F.col(name)))


def with_entity_texts(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with array<string>: the JSON text of each member of an entity container, places kept; null if it is cut off or holds none."""
    df = with_json_text(df, column, name)
    df = df.withColumn("_members", F.when(F.col(name).startswith("{"), F.from_json(F.col(name), "map<string,string>")))
    inner = F.element_at(F.map_values("_members"), 1)
    wrapped = (F.size("_members") == 1) & ~F.arrays_overlap(F.map_keys("_members"), F.array(*map(F.lit, MEMBERS))) & inner.rlike(r"^[\[{]")
    df = df.withColumn(name, F.when(wrapped, inner).otherwise(F.col(name))).drop("_members")
    return df.withColumn(name, json_list(F.col(name)))


def entities(clauses: DataFrame, id_col: str = "clause_id", column: str = "entities") -> DataFrame:
    """One row per member of each clause's entities: (id, pos, entity text, is_object, n_objects).

    Null, cut-off and scalar containers have no rows; members that are null have a null text and keep their place.
    """
    base = with_entity_texts(clauses.select(F.col(id_col), F.col(column).alias("_e")), "_e", "texts").where("texts is not null")
    objects = F.size(F.filter("texts", lambda x: x.startswith("{")))
    return base.select(F.col(id_col), objects.alias("n_objects"), F.posexplode("texts").alias("pos", "entity")).withColumn("is_object", F.coalesce(F.col("entity").startswith("{"), F.lit(False)))
