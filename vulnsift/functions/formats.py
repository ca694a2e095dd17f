"""Record formatting as Column expressions.

Formatting copies source text into prompts and messages, so builders call these last,
after every filter, rank and split, carrying only ids and sort keys through shuffles.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnsift.functions import text as tx
from vulnsift.schemas import (
    CHAT_MARKERS,
    INSTRUCTION,
    NO_VULNERABILITY_OUTPUT,
    RL_ZERO_PROMPT,
    SFT_DEFAULTS,
    SYSTEM_PROMPT,
    TRACE_PROMPT,
    VULN_FIELDS,
)


def _block(vuln_type, cwe, swc, lines, severity, explanation, remediation) -> Column:
    return F.concat(
        F.lit("Vulnerability: "), vuln_type, F.lit("\nCWE: "), cwe, F.lit("\nSWC: "), swc,
        F.lit("\nLines: "), lines, F.lit("\nSeverity: "), severity, F.lit("\nExplanation: "), explanation,
        F.lit("\nRemediation: "), remediation,
    )


def sft_block(v) -> Column:
    """P02 defaults: type->name->Unknown, lines->line_range->Unknown, explanation->description->text."""
    d = SFT_DEFAULTS
    return _block(
        F.coalesce(v["type"], v["name"], F.lit(d["vuln_type"])),
        F.coalesce(v["cwe_id"], F.lit(d["cwe_id"])),
        F.coalesce(v["swc_id"], F.lit(d["swc_id"])),
        F.coalesce(v["lines"], v["line_range"], F.lit(d["lines"])),
        F.coalesce(v["severity"], F.lit(d["severity"])),
        F.coalesce(v["explanation"], v["description"], F.lit(d["explanation"])),
        F.coalesce(v["remediation"], F.lit(d["remediation"])),
    )


def dpo_block(v) -> Column:
    """P05 defaults: no alias fallback; explanation and remediation default to ''."""
    return _block(
        F.coalesce(v["type"], F.lit("Unknown")),
        F.coalesce(v["cwe_id"], F.lit("CWE-Unknown")),
        F.coalesce(v["swc_id"], F.lit("SWC-Unknown")),
        F.coalesce(v["lines"], F.lit("Unknown")),
        F.coalesce(v["severity"], F.lit("Medium")),
        F.coalesce(v["explanation"], F.lit("")),
        F.coalesce(v["remediation"], F.lit("")),
    )


def sft_output(vulns="vulnerabilities", is_vulnerable="is_vulnerable") -> Column:
    """Blocks joined by a blank line; the fixed 'None' answer when not vulnerable or no list."""
    v = tx.col_(vulns)
    return F.when(tx.col_(is_vulnerable) & (F.size(v) > 0), F.array_join(F.transform(v, sft_block), "\n\n")) \
        .otherwise(F.lit(NO_VULNERABILITY_OUTPUT))


def analysis_text(vulns) -> Column:
    """P05 side: blocks of a (possibly empty) analysis, else the fixed 'None' answer."""
    v = tx.col_(vulns)
    return F.when(F.coalesce(F.size(v), F.lit(0)) > 0, F.array_join(F.transform(v, dpo_block), "\n\n")) \
        .otherwise(F.lit(NO_VULNERABILITY_OUTPUT))


def sft_instruction(include_system_prompt: bool = True) -> Column:
    return F.lit(f"{SYSTEM_PROMPT}\n\n{INSTRUCTION}" if include_system_prompt else INSTRUCTION)


def fenced(instruction: Column, code) -> Column:
    """Instruction, blank line, fenced Solidity code."""
    return F.concat(instruction, F.lit("\n\n```solidity\n"), tx.col_(code), F.lit("\n```"))


def zero_shot_prompt(code) -> Column:
    return fenced(F.lit(INSTRUCTION), code)


def chat_messages(instruction: Column, code, output: Column) -> Column:
    """[user: instruction + fenced code, assistant: output]."""
    return F.array(
        F.struct(F.lit("user").alias("role"), fenced(instruction, code).alias("content")),
        F.struct(F.lit("assistant").alias("role"), output.alias("content")),
    )


def json_string(c: Column) -> Column:
    """A string as JSON, with the escapes of Python's json.dumps: all but ASCII as lower-case \\uXXXX (null: null)."""
    j = F.to_json(F.struct(c.alias("v")), {"writeNonAsciiCharacterAsCodePoint": "true"})
    parts = F.regexp_extract_all(F.substring(j, 6, F.length(j) - 6), F.lit(r"\\u[0-9A-Fa-f]{4}|\\.|[^\\]+"), 0)
    low = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\\u"), F.lower(p)).otherwise(p)), "")
    return F.replace(low, F.lit("\x7f"), F.lit("\\u007f"))


def json_text(c: Column, kind: T.DataType, keep_nulls: bool = False) -> Column:
    """JSON text of a column of the given type as json.dumps writes it: ", " and ": ", escapes, keys in the order of the
    schema. A null field of a struct is left out, as a key that was never set, or with `keep_nulls` written as null; nulls in lists
    and maps are null."""
    def value(x: Column, t: T.DataType) -> Column:
        return F.coalesce(json_text(x, t, keep_nulls), F.lit("null"))

    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), json_string(c))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: value(x, kind.elementType)), ", "), F.lit("]"))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(json_string(e["key"].cast("string")), F.lit(": "), value(e["value"], kind.valueType)))
        return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(json.dumps(f.name) + ": "), value(c[f.name], f.dataType) if keep_nulls else json_text(c[f.name], f.dataType))
                  for f in kind.fields]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    return c.cast("string")  # numbers and booleans


def vulns_json(vulns) -> Column:
    """JSON text of a vulnerability list; fields that are not set are left out."""
    return json_text(tx.col_(vulns), T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in VULN_FIELDS])))


def _fill(template: str, **cols: Column) -> Column:
    """Fill {name} slots of a fixed template with columns (no Python per row)."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        name = rest[i + 1:j]
        if name in cols:
            if i:
                parts.append(F.lit(rest[:i]))
            parts.append(cols[name])
            rest = rest[j + 1:]
        else:
            parts.append(F.lit(rest[:j + 1]))
            rest = rest[j + 1:]
    return F.concat(*parts)


def trace_prompt(code, truth_json: Column) -> Column:
    """Reasoning-trace generation prompt with code and JSON ground truth."""
    return _fill(TRACE_PROMPT, contract_code=tx.col_(code), ground_truth=truth_json)


def rl_zero_prompt(code) -> Column:
    """RL-ZERO zero-shot prompt."""
    return _fill(RL_ZERO_PROMPT, contract_code=tx.col_(code))


def cpt_text(code, source_name: Column, include_header: bool = False) -> Column:
    """Optional '// Source: <name>' header line."""
    if include_header:
        return F.concat(F.lit("// Source: "), source_name, F.lit("\n"), tx.col_(code))
    return tx.col_(code)


def truncate_chars(text, max_length: int = 2048) -> Column:
    """P10: keep the first max_length*4 code points."""
    return F.substring(tx.col_(text), 1, max_length * 4)


def chat_turn(role: Column, content: Column) -> Column:
    """One rendered turn; roles outside system/user/assistant render as null (dropped)."""
    expr = None
    for r, marker in CHAT_MARKERS.items():
        piece = F.concat(F.lit(marker + "\n"), content, F.lit("\n"))
        expr = F.when(role == r, piece) if expr is None else expr.when(role == r, piece)
    return expr


def strip_think(text) -> Column:
    """P25: remove <think>...</think> blocks (across lines) and trim."""
    return tx.strip(F.regexp_replace(tx.col_(text), r"(?s)<think>.*?</think>", ""))


def tool_call_record(code, tool: str, args_json: Column, result: Column, answer: Column) -> Column:
    """User, assistant with a JSON <tool_call>, tool result, final answer."""
    call = F.concat(F.lit('<tool_call>{"name": "' + tool + '", "arguments": '), args_json, F.lit("}</tool_call>"))
    return F.array(
        F.struct(F.lit("user").alias("role"), zero_shot_prompt(code).alias("content")),
        F.struct(F.lit("assistant").alias("role"), call.alias("content")),
        F.struct(F.lit("tool").alias("role"), result.alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")),
    )
