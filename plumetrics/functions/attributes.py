"""Semi-structured attributes: typed columns out of JSON texts, and the reason why a text gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_attributes(df: DataFrame, text: str, fields: T.StructType | str, rejected: str = "rejected") -> DataFrame:
    """``df`` with a column for each of ``fields`` out of the JSON object in ``text``, and the reason of a rejection.

    A text that is no JSON is "malformed"; JSON that is no object is "not an object"; an object whose value does not
    fit the declared type is "bad <field>", the first such field in order. Rejected rows have no attributes at all. A
    missing text, a missing field and a JSON null are null and no reason to reject. A bad text never fails the job.
    """
    fields = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    parsed = df.withColumn("_json", F.try_parse_json(F.col(text)))
    json = F.col("_json")
    reason = F.when(F.col(text).isNotNull() & json.isNull(), "malformed")
    reason = reason.when(json.isNotNull() & ~F.schema_of_variant(json).startswith("OBJECT"), "not an object")
    for f in fields:
        raw = F.try_variant_get(json, f"$.{f.name}", "variant")
        present = raw.isNotNull() & ~F.is_variant_null(raw)
        reason = reason.when(present & F.try_variant_get(json, f"$.{f.name}", f.dataType.simpleString()).isNull(), f"bad {f.name}")
    judged = parsed.withColumn(rejected, reason)
    good = F.col(rejected).isNull()
    values = [F.when(good, F.try_variant_get(json, f"$.{f.name}", f.dataType.simpleString())).alias(f.name) for f in fields]
    return judged.select(*[c for c in df.columns if c not in (*fields.names, rejected)], *values, rejected)
