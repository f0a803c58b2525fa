"""Explicit schemas of the graph tables."""

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(S)


def _table(**cols):
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


SIDE_EFFECT = _table(type=S, confidence=D, source=S)
SEMANTICS = _table(side_effects=T.ArrayType(SIDE_EFFECT), control_flow=STRINGS, domain_hint=S,
                   execution_role=S, importance=D)
LINE_RANGE = T.StructType([T.StructField("start", I), T.StructField("end", I)])

FILES = _table(repo_id=S, path=S, file_name=S, length=L, mtime=T.TimestampType(), content=S, language=S)
NODES = _table(repo_id=S, id=S, type=S, name=S, file_path=S, line_range=LINE_RANGE, summary=S, tags=STRINGS,
               language=S, complexity=S, semantics=SEMANTICS, ord=S)
EDGES = _table(repo_id=S, src=S, dst=S, type=S, weight=D)
SYMBOLS = _table(repo_id=S, path=S, language=S, kind=S, seq=I, name=S, line_start=I, line_end=I,
                 params=STRINGS, decorators=STRINGS, bases=STRINGS, methods=STRINGS)
IMPORTS = _table(repo_id=S, path=S, seq=I, source=S, specifiers=STRINGS, line=I)
EXPORTS = _table(repo_id=S, path=S, seq=I, name=S, line=I)
CALL_SITES = _table(repo_id=S, path=S, token=S)
FINGERPRINTS = _table(repo_id=S, path=S, fp=S)
NODE_LAYER = _table(repo_id=S, id=S, layer_id=S)
FACTS = T.MapType(S, STRINGS)

# Flat layout of a node document, as the compact export writes it.
FLAT_NODES = _table(id=S, type=S, name=S, file_path=S, line_range=T.ArrayType(I), summary=S, tags=STRINGS,
                    language=S, complexity=S, domain=S, role=S, effects=STRINGS, control_flow=STRINGS, importance=D)
GRAPH_DOCUMENT_NODE = T.StructType(
    [T.StructField("repo_id", S), T.StructField("ord", S), *FLAT_NODES.fields, T.StructField("semantics", SEMANTICS)])
