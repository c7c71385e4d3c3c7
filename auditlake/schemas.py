"""Schemas of the tables this package reads and writes; nothing is inferred."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

PROMPT = _struct(prompt=_S, project_id=_S, author=_S, branch=_S)
LABELLED_PROMPT = T.StructType([T.StructField("label", _S), T.StructField("request", PROMPT)])

CONFLICT = _struct(severity=_S, category=_S, description=_S, affected_component=_S, remediation=_S)

ENDPOINT = _struct(
    project_id=_S, ord=_L, path=_S, method=_S, handler=_S, module=_S,
    parameters=T.ArrayType(_S), return_type=_S,
)
MODEL = _struct(project_id=_S, ord=_L, name=_S)
DEPENDENCY = _struct(project_id=_S, name=_S, version=_S)

FILE = _struct(path=_S, content=_S)
FINDING = _struct(
    severity=_S, category=_S, rule_id=_S, file=_S, line=_I, col=_I, snippet=_S,
    description=_S, remediation=_S,
)
SECRET_FINDING = _struct(file=_S, line=_I, type=_S, variable=_S, description=_S)
REQUIREMENT_LINE = _struct(project_id=_S, line_no=_I, line=_S)
IGNORE_LINE = _struct(root=_S, line_no=_I, line=_S)

DOC = _struct(ord=_L, id=_S, content=_S, metadata=T.MapType(_S, _S))
QUERY = _struct(query_id=_L, text=_S)

AUDIT = T.StructType(
    [
        T.StructField("audit_id", _S),
        T.StructField("prompt_id", _L),
        T.StructField("project_id", _S),
        T.StructField("author", _S),
        T.StructField("branch", _S),
        T.StructField("status", _S),
        T.StructField("prompt_summary", _S),
        T.StructField("conflicts", T.ArrayType(CONFLICT)),
        T.StructField("auto_remediation_applied", _B),
        T.StructField("recommended_tests", T.ArrayType(_S)),
        T.StructField("message", _S),
        T.StructField("created_at", T.TimestampType()),
    ]
)
