"""A name for what answers prompts: equal for the same code and settings, else different."""

from __future__ import annotations

import functools
import hashlib
import json
import sys
import types
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLAIN = (str, bytes, int, float, complex, bool, type(None), type(...))


def function_fingerprint(function: Callable) -> str:
    """A name that follows from a function's code, defaults, and the values it refers to.

    Functions and plain values among its closure and globals count with their content,
    classes with their methods, modules and what the standard library defines by name,
    other objects with their class and state. So a changed
    setting in a closure, or a changed helper, gives another name, and the same source read
    again the same. What has no content to compare, such as an open connection, is an error:
    a function that holds one needs a name of its own.
    """
    digest = hashlib.sha256()
    _add(digest.update, function, {})
    return digest.hexdigest()[:32]


def mapping_fingerprint(mapping: Mapping[str, str]) -> str:
    """A name that follows from the pairs of a mapping and their order."""
    pairs = json.dumps(list(mapping.items()))
    return hashlib.sha256(pairs.encode()).hexdigest()[:32]


def table_fingerprint(frame: DataFrame) -> str:
    """A name that follows from the rows of a table, in any order; one job."""
    columns = [F.col(f"`{c}`") for c in sorted(frame.columns)]
    # JSON of a row tells null from empty, and sums of two independent hashes its copies.
    row = F.to_json(F.struct(*columns))
    sums = frame.agg(
        F.count(F.lit(1)),
        F.sum(F.xxhash64(row).cast("decimal(38,0)")),
        F.sum(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("decimal(38,0)")),
    ).first()
    content = repr((sorted(frame.columns), [str(value) for value in sums]))
    return hashlib.sha256(content.encode()).hexdigest()[:32]


def _add(put: Callable[[bytes], None], value: object, seen: dict[int, int]) -> None:
    """Feed everything that tells `value` from others to `put`."""

    def name(kind: str, text: str) -> None:
        put(f"{kind} {len(text)} {text}\n".encode("utf-8", "surrogatepass"))

    def each(kind: str, values) -> None:
        values = list(values)
        name(kind, str(len(values)))
        for part in values:
            _add(put, part, seen)

    if isinstance(value, _PLAIN):
        name(type(value).__name__, repr(value))
    elif id(value) in seen:  # met before, perhaps on the way here
        name("again", str(seen[id(value)]))
    elif isinstance(value, types.ModuleType):
        name("module", value.__name__)
    elif isinstance(value, types.BuiltinFunctionType):
        name("name", f"{value.__module__}.{value.__qualname__}")
    else:
        seen[id(value)] = len(seen)
        if isinstance(value, type):
            name("class", f"{value.__module__}.{value.__qualname__}")
            if value.__module__.partition(".")[0] not in sys.stdlib_module_names:
                own = {k: v for k, v in vars(value).items() if isinstance(v, types.FunctionType)}
                each("methods", [part for pair in sorted(own.items()) for part in pair])
        elif isinstance(value, types.FunctionType):
            cells = [c.cell_contents for c in value.__closure__ or ()]
            each("function", [value.__code__, value.__defaults__, value.__kwdefaults__, *cells])
            used = sorted(_names(value.__code__) & value.__globals__.keys())
            each("globals", [x for n in used for x in (n, value.__globals__[n])])
        elif isinstance(value, types.CodeType):
            each("code", [value.co_code, value.co_names, value.co_consts])
        elif isinstance(value, types.MethodType):
            each("method", [value.__func__, value.__self__])
        elif isinstance(value, functools.partial):
            each("partial", [value.func, value.args, value.keywords])
        elif isinstance(value, (list, tuple)):
            each(type(value).__name__, value)
        elif isinstance(value, dict):
            each("dict", [part for pair in value.items() for part in pair])
        elif isinstance(value, (set, frozenset)):
            each("set", sorted(_own(part) for part in value))
        else:
            _add_object(each, value)


def _add_object(each: Callable, value: object) -> None:
    try:
        made = value.__reduce_ex__(4)
    except Exception as problem:
        raise ValueError(
            f"an answer that holds a {type(value).__name__} needs a name: give it as fingerprint"
        ) from problem
    if isinstance(made, str):
        each("object", [type(value), made])
        return
    build, arguments, state, items, pairs = (*made, None, None, None)[:5]
    each("object", [type(value), build, arguments, state, list(items or ()), list(pairs or ())])


def _own(value: object) -> str:
    digest = hashlib.sha256()
    _add(digest.update, value, {})
    return digest.hexdigest()


def _names(code: types.CodeType) -> set[str]:
    """Names a function and the functions inside it may look up among the globals."""
    inner = [c for c in code.co_consts if isinstance(c, types.CodeType)]
    return set(code.co_names).union(*(_names(c) for c in inner))
