"""Functions that need Python, as Arrow-batched UDFs over plain functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = "struct<entries:array<struct<position:int,accepted:array<string>>>,reason:string>"
ITEM_CAP = 100
ASK_WORDS = ("toping", "aniqlang", "hisoblang", "qaysi")
NODE = r"[XYZ][₀-₉0-9]*"


class Rejected(ValueError):
    pass


def _written(line: str) -> dict[int, list[str]]:
    heads = [m for m in re.finditer(r"(?:^|\s)(\d{1,3}):(?!\d)", line)]
    numbers = [int(h.group(1)) for h in heads]
    if len(heads) > 1 and numbers != list(range(numbers[0], numbers[0] + len(numbers))):
        raise Rejected("ambiguous")
    out = {}
    for h, end in zip(heads, [x.start() for x in heads[1:]] + [len(line)]):
        items = [" ".join(i.split()).upper()[:ITEM_CAP] for i in re.split(r"\s+/\s+", line[h.end() : end])]
        items = [i for i in items if any(c.isalnum() for c in i)]
        if not items:
            raise Rejected("empty")
        out[int(h.group(1))] = items
    return out


def parse_key(text: str | None) -> dict:
    """Accepted answers by position, or why the text can't be read.

    Lines 'N: value' are written answers, other lines letters: labelled, or bare from 1 on.
    """
    written: dict[int, list[str]] = {}
    letters = []
    try:
        for line in (text or "").splitlines():
            line = re.sub(r"^\s*(\d{1,3})(?:\s*[.)-]\s*|\s+)([+-]?\d[\d.,/]*)\s*$", r"\1: \2", line.strip())
            line = re.sub(r"^(\d{1,3})\s*[.)-]\s*([^\W\d_]\S+)$", r"\1: \2", line)
            if re.match(r"\d{1,3}:(?!\d)", line):
                written |= _written(line)
            elif line:
                letters.append(line)
        rest = " ".join(letters)
        if re.search(r"\d:\s*[^\d\s]{2,}", rest):
            raise Rejected("ambiguous")
        labelled = re.findall(r"(\d{1,3})\s*[-.):]?\s*([^\W\d_])(?![^\W\d_])", rest)
        if labelled:
            found = {int(n): [a.upper()] for n, a in labelled}
        else:
            found = {i: [a.upper()] for i, a in enumerate((c for c in rest if c.isalpha()), 1)}
        found |= written
        if not found:
            raise Rejected("empty")
        return {"entries": [{"position": k, "accepted": v} for k, v in sorted(found.items())], "reason": None}
    except Rejected as e:
        return {"entries": [], "reason": str(e)}


def answer_key(text: Column) -> Column:
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_key(t) for t in s], columns=["entries", "reason"])

    return F.pandas_udf(run, KEY)(text)


def canonical_chain(text: str | None) -> str | None:
    """Reagents that drifted beside an unknown node of a chain go back to the next arrow, until nothing moves."""
    if not text or text.count("→") < 2 or len(re.findall(rf"\b{NODE}\b", text)) < 2:
        return text
    segments = [s.strip() for s in text.split("→")]
    carried = ""
    out = []
    for i, s in enumerate(segments):
        reagent, own = "", s
        m = re.match(r"^(\([^)]*\))\s*(.*)$", s) if i else None
        lead, body = (m.group(1), m.group(2)) if m else ("", s)
        if i < len(segments) - 1 and "+" in body:
            head, tail = (x.strip() for x in body.split("+", 1))
            if "(" in tail or ")" in tail:  # groups are part of the node's side
                pass
            elif i and re.fullmatch(NODE, head):
                reagent, own = f"(+{tail})", f"{lead} {head}".strip() if lead else head
            elif not i and "+" not in tail and not re.fullmatch(NODE, head) and re.fullmatch(r"[A-Z][A-Za-z0-9₀-₉()]*", head):
                reagent, own = f"({tail})", head
        out.append(own if not i else f"→{carried} {own}" if carried else f"→{own}" if lead and not reagent and own == s else f"→ {own}")
        carried = reagent
    return re.sub(r" {2,}", " ", " ".join(out)).strip()


def chain(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(canonical_chain), "string")(text)


def missing_unknowns(text: str | None) -> list[str]:
    """Symbols that the last question asks for and no reaction of the stem has, unless the stem defines them."""
    stem = text or ""
    if not re.search("[→=]", stem):
        return []
    clauses = re.split(r"[.?!;\n]", stem)
    asks = [i for i, c in enumerate(clauses) if any(w in c.lower() for w in ASK_WORDS)]
    if not asks:
        return []
    given = " ".join(c for i, c in enumerate(clauses) if i != asks[-1] and re.search("[→=]", c))
    symbols = {m.group() for m in re.finditer(r"\b[ABDXYZ][₀-₉0-9]?\b", clauses[asks[-1]])} if given else set()
    lost = lambda x: not re.search(rf"\b{x}\b", given) and not re.search(rf"\b{x}\b\s*[=:∈]", stem)
    return sorted(x for x in symbols if lost(x))


def unanswerable(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(missing_unknowns), "array<string>")(text)


_LEX = re.compile(r"\s+|\d+(?:[.,]\d+)?|[A-Za-zα-ωΑ-Ω]+|√|[\^_/()+\-*=<>≤≥·]|.")


#: Function names that a formula may call, with the number of their arguments.
ROOTS = {"sqrt": 1, "root": 2}


class _Math:
    """Reads plain formulas by recursive descent and writes them as LaTeX."""

    def __init__(self, text: str):
        self.tokens = [t for t in _LEX.findall(text) if not t.isspace()]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def formula(self, stop: tuple[str, ...] = ()) -> str:
        out = []
        while self.peek() and self.peek() not in stop:
            out.append(self.fraction())
        return " ".join(out)

    def mixed(self) -> bool:
        """Whether a whole number and a fraction of two numbers stand here."""
        own = self.tokens[self.at : self.at + 4]
        return len(own) == 4 and own[2] == "/" and all(own[i].isdecimal() for i in (0, 1, 3))

    def fraction(self) -> str:
        whole = self.take() if self.mixed() else ""
        left = self.scripted()
        while self.peek() == "/":
            self.take()
            left = rf"\frac{{{self.bare(left)}}}{{{self.bare(self.scripted())}}}"
        return whole + left

    def scripted(self) -> str:
        base = self.atom()
        while self.peek() in ("^", "_"):
            mark = self.take()
            base += f"{mark}{{{self.bare(self.atom())}}}"
        return base

    @staticmethod
    def bare(x: str) -> str:
        return x[1:-1] if x.startswith("(") and x.endswith(")") else x

    def root(self, name: str) -> str:
        args = []
        while not args or self.peek() == ",":
            self.take()
            args.append(self.formula((",", ")")))
        if self.peek() != ")" or len(args) != ROOTS[name] or "" in args:
            raise ValueError("root is not closed or has other arguments")
        self.take()
        return rf"\sqrt[{args[0]}]{{{args[1]}}}" if name == "root" else rf"\sqrt{{{args[0]}}}"

    def atom(self) -> str:
        if not self.peek():
            raise ValueError("formula ends early")
        t = self.take()
        if t == "(":
            inner = self.formula((")",))
            if self.peek() != ")":
                raise ValueError("parenthesis stays open")
            self.take()
            return f"({inner})"
        if t in ROOTS and self.peek() == "(":
            return self.root(t)
        if t == "√" or t == "sqrt":
            return rf"\sqrt{{{self.bare(self.atom())}}}"
        if t in (")", "/", "^", "_"):
            raise ValueError("misplaced sign")
        return {"≤": r"\le", "≥": r"\ge", "·": r"\cdot", "*": r"\cdot"}.get(t, t)


_FORMULA = re.compile(r"(?:sqrt|root)\([^()]*(?:\([^()]*\)[^()]*)*\)|\b\d+ \d+/\d+\b|[A-Za-z0-9α-ω()√^_/+\-*=<>≤≥·.,]*[√^_/][A-Za-z0-9α-ω()√^_/+\-*=<>≤≥·.,]*(?:\s*[+\-*=<>≤≥·]\s*[A-Za-z0-9α-ω()√^_/]+)*")


def math_segments(text: str | None) -> list[dict]:
    """Prose and formulas in turn; what can't be read as a formula stays prose, letter by letter."""
    out: list[dict] = []
    at = 0
    for m in _FORMULA.finditer(text or ""):
        tail = re.search(r"[.,]*$", m.group()).group()
        body = m.group()[: len(m.group()) - len(tail)]
        try:
            latex = _Math(body).formula()
        except ValueError:
            continue
        if m.start() > at:
            out.append({"kind": "text", "body": text[at : m.start()]})
        out.append({"kind": "math", "body": latex})
        at = m.end() - len(tail)
    if at < len(text or ""):
        out.append({"kind": "text", "body": text[at:]})
    return out


def math(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(math_segments), "array<struct<kind:string,body:string>>")(text)
