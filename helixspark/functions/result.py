"""Results that carry all messages: struct(ok, value, messages)."""

from __future__ import annotations

import traceback
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dna import _c


def checked(value: Column, checks: list[tuple[Column, Column | str]]) -> Column:
    """value, if all conditions hold; the messages of those that don't."""
    messages = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for ok, m in checks)))
    ok = F.size(messages) == 0
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), messages.alias("messages"))


def succeeded(value: Column, *warnings: str) -> Column:
    return F.struct(F.lit(True).alias("ok"), value.alias("value"), F.array(*map(F.lit, warnings)).cast("array<string>").alias("messages"))


def failed(message: Column | str, kind: str = "string") -> Column:
    return F.struct(F.lit(False).alias("ok"), F.lit(None).cast(kind).alias("value"), F.array(F.lit(message) if isinstance(message, str) else message).alias("messages"))


def bound(r: Column | str, f) -> Column:
    """f(value) of a success, its own messages behind those there are; a failure stays."""
    r = _c(r)
    n = f(r["value"])
    return F.when(r["ok"], F.struct(n["ok"].alias("ok"), n["value"].alias("value"), F.concat(r["messages"], n["messages"]).alias("messages"))).otherwise(F.struct(F.lit(False).alias("ok"), F.when(F.lit(False), n["value"]).alias("value"), r["messages"].alias("messages")))


def lifted(f, a: Column | str, b: Column | str) -> Column:
    """f of two values; the messages of both, if one has failed."""
    a, b = _c(a), _c(b)
    ok = a["ok"] & b["ok"]
    return F.struct(ok.alias("ok"), F.when(ok, f(a["value"], b["value"])).alias("value"), F.concat(a["messages"], b["messages"]).alias("messages"))


def mapped_messages(r: Column | str, f) -> Column:
    r = _c(r)
    return F.struct(r["ok"].alias("ok"), r["value"].alias("value"), F.transform(r["messages"], f).alias("messages"))


def status(r: Column | str) -> Column:
    """Fail, Warn or Pass."""
    r = _c(r)
    return F.when(~r["ok"], "Fail").when(F.size(r["messages"]) > 0, "Warn").otherwise("Pass")


def value_or_raise(r: Column | str) -> Column:
    r = _c(r)
    return F.when(r["ok"], r["value"]).otherwise(F.raise_error(F.array_join(r["messages"], "; ")))


def collected(df: DataFrame, group: str, r: str, order: str) -> DataFrame:
    """group, ok, value (of all, in order), messages (of all, in order)."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.col(r)["ok"].alias("ok"), F.col(r)["value"].alias("value"), F.col(r)["messages"].alias("messages"))))
    c = df.groupBy(group).agg(rows.alias("__rows"))
    ok = F.forall("__rows", lambda x: x["ok"])
    return c.select(group, ok.alias("ok"), F.when(ok, F.transform("__rows", lambda x: x["value"])).alias("value"), F.flatten(F.transform("__rows", lambda x: x["messages"])).alias("messages"))


def of_optional(value: Column | str, message: Column | str) -> Column:
    """A success with the value, or a failure with the message where it is null."""
    value = _c(value)
    return checked(value, [(value.isNotNull(), message)])


def of_choice(value: Column | str, message: Column | str) -> Column:
    """Of two columns, one of which is null: a success with the first, or a failure with the second as its message."""
    return checked(_c(value), [(_c(value).isNotNull(), _c(message).cast("string"))])


def optional(value: Column | str, f) -> Column:
    """f(value), a result, where there is a value; a success with null elsewhere."""
    value = _c(value)
    r = f(value)
    none = F.struct(F.lit(True).alias("ok"), F.when(F.lit(False), r["value"]).alias("value"), F.array().cast("array<string>").alias("messages"))
    return F.when(value.isNull(), none).otherwise(F.struct(r["ok"].alias("ok"), r["value"].alias("value"), r["messages"].alias("messages")))


def exception_text(e: BaseException, message: str | None = None) -> str:
    """Message, type, attributes and trace of an exception and of all that caused it, numbered from the second on."""
    out, number = [] if message is None else [message], 1
    while e is not None:
        head = str(e) if number == 1 else f"{number}) {e}"
        more = [f"{k}: {v}" for k, v in sorted(vars(e).items())]
        out.append("\n".join([head, f"Type: {type(e).__module__}.{type(e).__qualname__}", *more, *(x.rstrip("\n") for x in traceback.format_tb(e.__traceback__))]))
        e, number = e.__cause__ or (None if e.__suppress_context__ else e.__context__), number + 1
    return "\n\n".join(out)


def caught(f: Callable, value: Column | str, kind: str = "string", message: Callable[[BaseException], str] = str) -> Column:
    """f of each value; an exception becomes a failure with the message made of it. f is Python, so keep it off hot paths."""

    def one(x):
        try:
            return {"ok": True, "value": f(x), "messages": []}
        except Exception as e:
            return {"ok": False, "value": None, "messages": [message(e)]}

    @F.pandas_udf(f"ok boolean, value {kind}, messages array<string>")
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in column.tolist()], columns=["ok", "value", "messages"])

    return run(_c(value))
