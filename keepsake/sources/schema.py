"""Table schemas of the store (made without a session)."""

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "float": T.FloatType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "strings": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.StringType())}
_REFS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("digest", T.StringType())]))


def struct(fields: str, **other: T.DataType) -> T.StructType:
    """``name:type`` pairs; the type is one of the simple ones or named in ``other``."""
    return T.StructType([T.StructField(n, other.get(t) or _SIMPLE[t]) for n, t in (f.split(":") for f in fields.split())])


ITEMS = struct(
    "tenant:string subject:string namespace:string id:string body:string kind:string source_kind:string source_id:string occurred_at_s:long created_at_s:long tags:strings attrs:map "
    "sensitivity:int ttl_seconds:long protection:string protected_until_s:long byte_size:long last_access_s:long access_count:long pending_embedding:boolean"
)
VECTORS = struct("tenant:string subject:string namespace:string item_id:string embedder:string dim:int scale:float q:binary")
AUDIT = struct("tenant:string id:string at_s:long day:long subject:string namespace:string event:string items:refs policy_name:string policy_version:string value:float fragility:float reason:string actor:string", refs=_REFS)
BUDGETS = struct("tenant:string subject:string namespace:string max_items:long max_bytes:long")
IDEMPOTENCY = struct("tenant:string subject:string namespace:string key:string payload_digest:string outcome:string at_s:long")
TABLES = {"items": ITEMS, "vectors": VECTORS, "audit": AUDIT, "budgets": BUDGETS, "idempotency": IDEMPOTENCY}
VERSION = 2
