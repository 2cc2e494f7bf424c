"""Arithmetic programs: two-place steps with back references, folded in the JVM.

A program is array<struct<operation string, arguments array<variant>>>. A value is a
tagged struct (num, str); errors are values: once a step fails, later ones are passed
over, the trace up to it is kept and ``error`` tells why.

Cases: null and empty programs give an error, not a failure; null operands cannot be
parsed; ``#-1`` is the last result; results that are not finite are errors; very long
programs fold step by step within one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Operations, units and scales.
OPERATIONS = ["add", "subtract", "multiply", "divide", "exp", "greater"]
UNITS = {
    "percent": ("", "%"), "percentage": ("", "%"), "percentage_points": ("", " percentage points"), "million": ("", " million"), "millions": ("", " million"),
    "billion": ("", " billion"), "billions": ("", " billion"), "dollar": ("$", ""), "dollars": ("$", ""), "share": ("", " shares"), "shares": ("", " shares"),
}
PROGRAM = "array<struct<operation:string,arguments:array<variant>>>"
VALUE = "struct<num:double,str:string>"
STATE = f"struct<results:array<{VALUE}>,trace:array<string>,error:string>"


def parse_number(text: Column) -> Column:
    """The first number of a text; $ , % are dropped, enclosing parentheses negate; null if there is none."""
    t = F.regexp_replace(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), "[$,%]", "")
    t = F.when(t.startswith("(") & t.endswith(")"), F.concat(F.lit("-"), F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    return F.regexp_extract(t, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def format_number(v: Column) -> Column:
    """At most five decimals, none for whole numbers (within 1e-9 of their size)."""
    whole = F.rint(v)
    shape = lambda x, form: F.call_function("format_number", x, F.lit(form))
    text = F.when(F.abs(v - whole) <= 1e-9 * F.abs(v), shape(whole, "0")).otherwise(shape(v, "0.#####"))
    return F.regexp_replace(text, "^-0$", "0")


def label(c: Column) -> Column:
    return F.translate(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), " -", "__")


def format_answer(v: Column, unit: Column, scale: Column) -> Column:
    """The number with its unit; percentages at most 1 in size are multiplied by 100 unless the scale is raw."""
    u, s = F.coalesce(label(unit), F.lit("")), F.coalesce(F.when(label(scale) != "", label(scale)), F.lit("auto"))
    percent = u.isin("percent", "percentage") & (F.abs(v) <= 1) & s.isin("auto", "ratio_to_percent")
    number = format_number(F.when(percent, v * 100).otherwise(v))
    out = number
    for name, (before, after) in UNITS.items():
        out = F.when(u == name, F.concat(F.lit(before), number, F.lit(after))).otherwise(out)
    return out


def _value(num: Column | None = None, text: Column | None = None) -> Column:
    return F.struct((F.lit(None).cast("double") if num is None else num.cast("double")).alias("num"), (F.lit(None).cast("string") if text is None else text).alias("str"))


def _operand(arg: Column, results: Column) -> Column:
    """struct(value, error)"""
    is_text = F.schema_of_variant(arg) == "STRING"
    is_bool = F.schema_of_variant(arg) == "BOOLEAN"
    number = F.when(is_bool, F.try_variant_get(arg, "$", "boolean").cast("double")).when(~is_text, F.try_variant_get(arg, "$", "double"))
    text = F.regexp_replace(F.coalesce(F.try_variant_get(arg, "$", "string"), F.lit("None")), r"(?U)^\s+|\s+$", "")
    ref = F.regexp_extract(text, r"^#\s*([+-]?\d+)$", 1).try_cast("int")
    at = F.when(ref >= 0, ref).otherwise(ref + F.size(results))
    body = F.when(text.startswith("const_"), F.substr(text, F.lit(7))).otherwise(text)
    parsed = parse_number(body)
    no, none = F.lit(None).cast("string"), F.lit(None).cast(VALUE)
    ok = lambda v: F.struct(v.cast(VALUE).alias("value"), no.alias("error"))
    bad = lambda e: F.struct(none.alias("value"), e.alias("error"))
    return (
        F.when(number.isNotNull(), ok(_value(number)))
        .when(text == "", bad(F.lit("Empty calculation operand.")))
        .when(text.startswith("#") & ref.isNull(), bad(F.concat(F.lit("Step reference "), text, F.lit(" is no number."))))
        .when(text.startswith("#") & ((at < 0) | (at >= F.size(results))), bad(F.concat(F.lit("Step reference "), text, F.lit(" does not exist."))))
        .when(text.startswith("#"), ok(F.get(results, at)))
        .when(parsed.isNull(), bad(F.concat(F.lit("Could not parse numeric operand: "), body)))
        .otherwise(ok(_value(parsed)))
    )


def shown(v: Column) -> Column:
    return F.coalesce(v["str"], format_number(v["num"]))


def _result(name: Column, left: Column, right: Column) -> Column:
    a, b = left["num"], right["num"]
    num = F.when(name == "add", a + b).when(name == "subtract", a - b).when(name == "multiply", a * b).when(name == "divide", F.try_divide(a, b)).when(name == "exp", F.pow(a, b))
    return F.when(name == "greater", _value(text=F.when(a > b, "yes").otherwise("no"))).otherwise(_value(num)).cast(VALUE)


def _taken(s: Column, x: Column, name: Column, args: Column, o: Column, value: Column) -> Column:
    """The state after a step with operands ``o`` and result ``value``."""
    left, right = o["left"], o["right"]
    num, word = value["num"], F.coalesce(left["value"]["str"], right["value"]["str"])
    error = (
        F.when(~name.isin(OPERATIONS), F.concat(F.lit("Unsupported operation: "), F.coalesce(x["operation"], F.lit(""))))
        .when(F.size(args) != 2, F.concat(name, F.lit(" expects exactly two arguments.")))
        .when(left["error"].isNotNull(), left["error"])
        .when(right["error"].isNotNull(), right["error"])
        .when(word.isNotNull(), F.concat(F.lit("could not convert string to float: '"), word, F.lit("'")))
        .when((name == "divide") & (right["value"]["num"] == 0), F.lit("Cannot divide by zero."))
        .when((name != "greater") & (num.isNull() | F.isnan(num) | (F.abs(num) == float("inf"))), F.lit("Result is not a finite number."))
    )
    line = F.concat(F.lit("#"), F.size(s["results"]).cast("string"), F.lit(" = "), name, F.lit("("), shown(left["value"]), F.lit(", "), shown(right["value"]), F.lit(") = "), shown(value))
    failed = F.struct(s["results"].alias("results"), s["trace"].alias("trace"), error.alias("error")).cast(STATE)
    went = F.struct(F.concat(s["results"], F.array(value)).alias("results"), F.concat(s["trace"], F.array(line)).alias("trace"), F.lit(None).cast("string").alias("error")).cast(STATE)
    return F.when(s["error"].isNotNull(), s).when(error.isNotNull(), failed).otherwise(went)


def execute(steps: Column, unit: Column, scale: Column) -> Column:
    """struct(num, str, formatted, trace, error) of a program."""
    empty = F.struct(F.array().cast(f"array<{VALUE}>").alias("results"), F.array().cast("array<string>").alias("trace"), F.lit(None).cast("string").alias("error")).cast(STATE)

    def step(s: Column, x: Column) -> Column:
        name = F.lower(F.regexp_replace(F.coalesce(x["operation"], F.lit("")), r"(?U)^\s+|\s+$", ""))
        args = F.coalesce(x["arguments"], F.array().cast("array<variant>"))
        operands = F.struct(_operand(F.get(args, F.lit(0)), s["results"]).alias("left"), _operand(F.get(args, F.lit(1)), s["results"]).alias("right"))
        return T.let(operands, lambda o: T.let(_result(name, o["left"]["value"], o["right"]["value"]), lambda v: _taken(s, x, name, args, o, v)))

    def finish(s: Column) -> Column:
        last = F.when(s["error"].isNull(), F.try_element_at(s["results"], F.lit(-1)))
        error = F.when(F.size(s["trace"]) + F.size(s["results"]) == 0, F.coalesce(s["error"], F.lit("No calculation steps were provided."))).otherwise(s["error"])
        return T.let(last, lambda last: F.struct(
            last["num"].alias("num"), last["str"].alias("str"), F.coalesce(last["str"], format_answer(last["num"], unit, scale)).alias("formatted"),
            F.when(F.size(s["trace"]) > 0, F.array_join(s["trace"], "\n")).alias("trace"), error.alias("error"),
        ))

    return F.aggregate(F.coalesce(steps, F.array().cast(PROGRAM)), empty, step, finish)


def program(text: Column) -> Column:
    """The steps in a JSON text; null for null, empty or invalid texts."""
    return F.from_json(F.when(F.trim(text) != "", text), PROGRAM)
