from rankflow.functions.text import (
    content_key, norm_text, py_strip, nullif_empty, truthy_str, collapse_ws, WS_CLASS,
)
from rankflow.functions.variant import vtype, vtruthy, vstr, vfield, vfirst_truthy

__all__ = [
    "content_key", "norm_text", "py_strip", "nullif_empty", "truthy_str", "collapse_ws", "WS_CLASS",
    "vtype", "vtruthy", "vstr", "vfield", "vfirst_truthy",
]
