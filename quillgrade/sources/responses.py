"""Raw model responses as tables: salvaged JSON, sheets, question records."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrade.operators.grading import canonical_letter

NAME_CAP = 100
QUESTION = "struct<question_number:int,question_text:string,options:array<struct<letter:string,text:string>>,has_image:boolean,image_description:string,section_title:string,is_fragment:boolean>"


def salvage(raw: Column) -> Column:
    """The JSON object in a response: fences go, then everything outside the outermost braces."""
    bare = F.regexp_replace(raw, r"(?s)```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def classify(value: Column) -> Column:
    """An option letter, 'unclear' for a question mark, 'text:' and the text, or null."""
    own = F.trim(value)
    return F.when(own.isNull() | (own == ""), None).when(own == "?", "unclear").when(canonical_letter(own).rlike("^[A-EБГ]$"), canonical_letter(own)).otherwise(F.concat(F.lit("text:"), own))


def variant_number(text: Column) -> Column:
    return F.regexp_extract(text, "[0-9]+", 0).try_cast("int")


def as_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "yes", "1"), F.lit(False))


def clean_name(text: Column) -> Column:
    own = F.trim(text)
    return F.when(~F.lower(own).isin("null", ""), F.left(own, F.lit(NAME_CAP)))


def sheets(raw: DataFrame) -> DataFrame:
    """Sheet responses: variant, name, flag, and each answer classified."""
    j = salvage(F.col("raw"))
    answers = F.from_json(F.get_json_object(j, "$.answers"), "map<string,string>")
    return raw.select(
        "sheet_id",
        variant_number(F.get_json_object(j, "$.variant")).alias("variant"),
        clean_name(F.get_json_object(j, "$.name")).alias("student_name"),
        as_bool(F.get_json_object(j, "$.name_unclear")).alias("name_unclear"),
        F.transform_values(answers, lambda _, v: classify(v)).alias("answers"),
    )


#: Names that responses use for the fields of a question.
_ALIASES = {
    "question_number": ("question_number", "number", "num", "n"),
    "question_text": ("question_text", "question", "text", "q"),
    "options": ("options", "opts", "choices"),
    "has_image": ("has_image", "img"),
    "image_description": ("image_description", "desc"),
    "section_title": ("section_title", "section"),
    "is_fragment": ("is_fragment", "fragment"),
}


def _records(raw: str | None) -> list[dict]:
    """Question objects of a response: whole JSON, else the array or object in it, else the objects before the cut."""
    text = re.sub(r"```(?:json)?", "", raw or "").strip()
    spans = [text, *[text[text.find(a) : text.rfind(b) + 1] for a, b in ("[]", "{}") if a in text and b in text]]
    for s in spans:
        try:
            found = json.loads(s)
        except ValueError:
            continue
        if isinstance(found, dict):
            inner = next((v for k, v in found.items() if isinstance(v, list) and k not in _ALIASES["options"]), None)
            found = [found] if inner is None else inner
        if isinstance(found, list):
            return _ungrouped(x for x in found if isinstance(x, dict))
    reader, out, at = json.JSONDecoder(), [], text.find("{")
    while at >= 0:
        try:
            item, end = reader.raw_decode(text, at)
            out.append(item)
            at = text.find("{", end)
        except ValueError:
            at = text.find("{", at + 1)
    return _ungrouped(x for x in out if isinstance(x, dict))


def _ungrouped(items) -> list[dict]:
    """Groups of questions give their questions, in order."""
    out = []
    for x in items:
        inner = x.get("questions")
        out += [q for q in inner if isinstance(q, dict)] if isinstance(inner, list) else [x]
    return out


def _record(item: dict) -> dict:
    got = {k: next((item[a] for a in names if a in item), None) for k, names in _ALIASES.items()}
    options = got["options"]
    if options is None:
        options = {k: item[k] for k in "ABCDE" if k in item}
    pairs = options.items() if isinstance(options, dict) else [(o.get("letter", "ABCDE"[i % 5]), o.get("text")) if isinstance(o, dict) else ("ABCDE"[i % 5], o) for i, o in enumerate(options or [])]
    number = re.search(r"\d+", str(got["question_number"] or ""))
    text = lambda v: None if v is None else str(v)
    return {
        "question_number": int(number.group()) if number else 0,
        "question_text": text(got["question_text"]) or "",
        "options": [{"letter": str(k), "text": text(v)} for k, v in pairs],
        "has_image": bool(got["has_image"]),
        "image_description": text(got["image_description"]),
        "section_title": text(got["section_title"]),
        "is_fragment": bool(got["is_fragment"]),
    }


def _parse(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: [_record(x) for x in _records(r)])


def question_rows(raw: DataFrame) -> DataFrame:
    """A row each question of the responses, in the order of the response."""
    parsed = raw.select("doc_id", "page_number", F.pandas_udf(_parse, f"array<{QUESTION}>")("raw").alias("qs"))
    return parsed.select("doc_id", "page_number", F.posexplode("qs").alias("pos", "q")).select("doc_id", "page_number", (F.col("pos") + 1).alias("pos"), "q.*")
