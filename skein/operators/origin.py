"""Where imports come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Import prefixes and the projects they belong to.
PREFIXES = {"lib.example/auth": "auth", "lib.example/ctl": "ctl", "lib.example/kube": "kube", "lib.example/obs": "obs", "lib.example/store": "store", "lib.example/wire": "wire", "code.example": "fleet"}


def classify(paths: DataFrame, prefixes: dict[str, str] = PREFIXES) -> DataFrame:
    """``paths`` (path, ..) with ``origin``, that of the longest prefix a path begins with (''
    if none does), and ``stdlib``: no dot in the first segment. A raw prefix, not of segments."""
    known = sorted(prefixes.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    origin = F.lit("")
    for prefix, name in reversed(known):
        origin = F.when(F.col("path").startswith(prefix), name).otherwise(origin)
    return paths.withColumns({"origin": origin, "stdlib": ~F.contains(F.substring_index("path", "/", 1), F.lit("."))})
