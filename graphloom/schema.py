"""Schemas of the code graph and of findings."""

from pyspark.sql import types as T

_L, _S, _B = T.LongType(), T.StringType(), T.BooleanType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


FILES = _table(id=_L, path=_S, language=_S, content_hash=_S, symbols_hash=_S, mtime=_L, size=_L, is_test=_B, last_indexed=_L)
IMPORTS = _table(file_id=_L, module=_S, stem=_S)
EXPORTS = _table(file_id=_L, name=_S)
SYMBOLS = _table(
    id=_L, file_id=_L, name=_S, container=_S, qualified=_S, kind=_S, start_line=_L, end_line=_L, signature=_S, exported=_B, route_method=_S, route_path=_S
)
CALLS = _table(symbol_id=_L, callee=_S, receiver=_S, qualifier=_S, line=_L, character=_L)
EXTENDS = _table(symbol_id=_L, name=_S)
SERVICE_LINKS = _table(symbol_id=_L, method=_S, url=_S)
FINDINGS = _table(rule_id=_S, title=_S, severity=_S, confidence=_S, blocking=_B, path=_S, line=_L, end_line=_L, evidence=_S, recommendation=_S)
CHANGED_LINES = _table(path=_S, start=_L, end=_L)
BASELINE = _table(rule_id=_S, severity=_S, path=_S, evidence=_S, count=_L)
