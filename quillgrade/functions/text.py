"""Text functions over question stems, options and captions, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrade.operators.dedup import fingerprint_norm

#: Rewrites of mathematical markup, in order. Patterns are regular expressions, literals plain text.
FRACTIONS = (r"\\frac\{([^{}]+)\}\{([^{}]+)\}", r"(\1)/(\2)", 4)
FIRST_PATTERNS = [(r"\\sqrt\{([^{}]+)\}", r"sqrt(\1)"), (r"\\sqrt\[([^\]]+)\]\{([^{}]+)\}", r"\1_root(\2)")]
LITERALS = [
    (r"\cdot", " * "), (r"\times", " x "), (r"\div", " / "), (r"\leq", "<="), (r"\geq", ">="), (r"\neq", "!="), (r"\ne", "!="),
    (r"\infty", "∞"), (r"\pi", "π"), (r"\alpha", "α"), (r"\beta", "β"), (r"\gamma", "γ"), (r"\delta", "δ"), (r"\epsilon", "ε"),
    (r"\theta", "θ"), (r"\lambda", "λ"), (r"\mu", "μ"), (r"\sigma", "σ"), (r"\omega", "ω"), (r"\phi", "φ"), (r"\psi", "ψ"),
    (r"\in", "∈"), (r"\notin", "∉"), (r"\cup", "∪"), (r"\cap", "∩"), (r"\subset", "⊂"),
]
LAST_PATTERNS = [
    (r"\^\{([^{}]+)\}", r"^(\1)"), (r"_\{([^{}]+)\}", r"_(\1)"), (r"\$\$([^$]+)\$\$", r"\1"), (r"\$([^$]+)\$", r"\1"),
    (r"\\begin\{[^}]+\}", ""), (r"\\end\{[^}]+\}", ""), (r"\\text\{([^{}]+)\}", r"\1"), (r"\\[a-zA-Z]+\b", ""),
    (r"([A-Za-z0-9\)])tutgan\b", r"\1 tutgan"), (r"  +", " "),
]
#: Whole words that recognition confuses, and what they mean.
CORRECTIONS = {
    "fill": "(II)", "yasliil": "yashil", "nccha": "necha", "oltinugurt": "oltingugurt", "oksidlarridan": "oksidlaridan",
    "bodishi": "bo'lishi", "issiqdik": "issiqlik", "issiqilik": "issiqlik",
}
#: Words by which a stem refers to a figure or to a scheme.
IMAGE_WORDS = ("rasmda", "rasmga", "jadvalda", "diagrammada", "grafikda", "shakl", "ko'rsatilgan", "koʻrsatilgan", "tasvirlangan", "sxemada")
SCHEME_WORDS = ("o'zgarishlar asosida", "oʻzgarishlar asosida", "quyidagi sxema", "quyidagi o'zgarish")
FORMULA = r"\b[A-Z][a-z]?[0-9]|\b(?:[A-Z][a-z]?){2,}\b"
TOKEN = r"[\p{L}\p{N}]+"


def _java(replacement: str) -> str:
    return replacement.replace("$", r"\$").replace(r"\1", "$1").replace(r"\2", "$2")


def clean_latex(text: Column) -> Column:
    """Mathematical markup as plain readable text."""
    pattern, to, times = FRACTIONS
    for _ in range(times):
        text = F.regexp_replace(text, pattern, _java(to))
    for p, to in FIRST_PATTERNS:
        text = F.regexp_replace(text, p, _java(to))
    for literal, to in LITERALS:
        text = F.replace(text, F.lit(literal), F.lit(to))
    for p, to in LAST_PATTERNS:
        text = F.regexp_replace(text, p, _java(to))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def correct_words(text: Column) -> tuple[Column, Column]:
    """The text with confused words corrected, and how many were."""
    n = F.lit(0)
    for wrong, right in CORRECTIONS.items():
        pattern = rf"(?U)\b{wrong}\b"
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, right)
    return text, n


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return F.coalesce(out, F.lit(False))


def strip_own_number(text: Column, number: Column) -> Column:
    """Drops a leading token that is the question's own number, behind four marks and a caret at most."""
    return F.when(number > 0, F.regexp_replace(text, F.concat(F.lit(r"^\s*[`*~_#]{0,4}\s*\^?"), number.cast("string"), F.lit(r"\s*[.)]\s*")), F.lit(""))).otherwise(text)


def strip_backticks(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*`+\s*", "")


def strip_inline_options(text: Column, options: Column) -> Column:
    """Cuts a stem where its options stand in it again: three options or more, and two of them found behind 'A)'."""
    at = F.regexp_instr(text, F.lit(r"\bA\)"))
    tail = F.substring(text, at, F.length(text))
    norm = fingerprint_norm(tail)
    hits = F.size(F.filter(options, lambda o: (F.left(fingerprint_norm(o), F.lit(12)) != "") & F.contains(norm, F.left(fingerprint_norm(o), F.lit(12)))))
    cut = (F.size(options) >= 3) & (at > 0) & F.contains(tail, F.lit("B)")) & F.contains(tail, F.lit("C)")) & (hits >= 2)
    return F.when(cut, F.rtrim(F.substring(text, F.lit(1), at - 1))).otherwise(text)


#: Words that introduce an author, and the forms of channel lines and handles in the texts.
LABELS = "tuzuvchi|muallif|mualif|author"
CREDIT = rf"(?im)[ \t]*(?:{LABELS}|составител[\p{{L}}]*)\s*[:：][^\n]*$"
CHANNEL = r"(?im)^.*\btelegram\b[^\n]*\bkanal[\p{L}]*[^\n]*$"
HANDLE = r"@[_a-zA-Z0-9]{3,}"


def credit_names(rows: DataFrame, by: str, text: str) -> DataFrame:
    """Names after author labels, as words of four letters or more, per document."""
    name = F.trim(F.regexp_extract(text, rf"(?i)(?:{LABELS})\s*[:：]\s*([\p{{L}}][\p{{L}} ʻ’'`]*)", 1))
    words = F.filter(F.split(name, r"\s+"), lambda w: F.length(w) >= 4)
    own = rows.where((F.size(F.split(name, r"\s+")) <= 4) & (name != "")).select(by, F.explode(words).alias("w"))
    return own.groupBy(by).agg(F.array_sort(F.collect_set("w")).alias("names"))


def strip_credits(text: Column, names: Column) -> Column:
    """Without author lines, channel lines, handles and the given names."""
    for p in (CREDIT, CHANNEL, HANDLE):
        text = F.regexp_replace(text, p, "")
    own = F.concat(F.lit(r"(?i)(?<![\p{L}])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}])"))
    text = F.when(F.size(names) > 0, F.regexp_replace(text, own, F.lit(""))).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^[ _\n\t]+|[ _\n\t]+$", "")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct elements of ``a`` that are in ``b``."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(0.0)


def reveals_answer(description: Column, answer: Column) -> Column:
    """Whether a description names the whole answer, if that has two words or more."""
    words = F.filter(tokens(answer), lambda t: t.rlike(r"\p{L}"))
    return F.coalesce((F.size(words) >= 2) & is_subset(words, tokens(description)), F.lit(False))


def meta_description(text: Column) -> Column:
    """Sentences about whether there is a figure, instead of its description."""
    own = r"(?i)\b(?:does\s*not|does\s*n.t|do\s*not|don.t|did\s*not|didn.t)\s+(?:contain|have|include|show|depict)\b|\bthere\s+is\s+no\b|\bno\s+(?:scheme|diagram|transformation)\b|^\s*question\s+[0-9]+\b"
    return F.coalesce(text.rlike(own), F.lit(False))


def needs_scheme(text: Column, has_image: Column, description: Column) -> Column:
    return has_image | (F.coalesce(description, F.lit("")) != "") | mentions(text, SCHEME_WORDS)


def has_scheme(text: Column, options: Column, description: Column, image: Column) -> Column:
    arrows = F.contains(F.concat_ws(" ", text, options), F.lit("→"))
    useful = ~description.rlike(r"(?i)cut ?off|is cut|kesilgan|not (?:visible|readable)") & description.rlike(FORMULA)
    return image.isNotNull() | F.coalesce(arrows, F.lit(False)) | F.coalesce(useful, F.lit(False))


def redundant_description(text: Column, description: Column) -> Column:
    """A description that only restates the chain of the stem: its formulas, or two or more of its numbers."""
    formulas = F.array_distinct(F.regexp_extract_all(description, F.lit(rf"({FORMULA}|\b[XYZ][0-9]?\b)"), F.lit(1)))
    known = F.size(F.filter(formulas, lambda t: F.contains(text, t))) / F.greatest(F.size(formulas), F.lit(1))
    numbers = F.array_distinct(F.regexp_extract_all(description, F.lit("[0-9]+"), F.lit(0)))
    mapped = (F.size(numbers) >= 2) & is_subset(numbers, F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)))
    return F.coalesce(F.contains(text, F.lit("→")) & (((F.size(formulas) > 0) & (known >= 0.9)) | mapped), F.lit(False))


def scheme_ladder(text: Column, has_image: Column, description: Column, image: Column, transcript: Column) -> Column:
    """How a question gets its scheme: it has one, a transcript with arrows or rows and a formula, a description, or none."""
    kept = F.when(~redundant_description(text, description) & ~meta_description(description), description)
    rows = F.regexp_count(transcript, F.lit(r"(?m)^\s*[0-9]+[.)]")) >= 2
    good = (F.contains(transcript, F.lit("→")) | rows) & transcript.rlike(FORMULA)
    return F.when(~needs_scheme(text, has_image, kept), "none_needed").when(has_scheme(text, F.lit(""), kept, image), "present").when(good, "transcript").when(F.coalesce(kept, F.lit("")) != "", "description").otherwise("failed")


def suspicious(text: Column, options: Column) -> Column:
    """Slugs of what looks corrupted; nothing is rewritten."""
    full = F.concat_ws(" ", text, options)
    ratio = F.regexp_extract(full, r"\b([0-9]+(?:\s*:\s*[0-9]+)+)\b", 1)
    formulas = F.regexp_extract_all(full, F.lit(r"\b(?:[A-Z][a-z]?[0-9]*){2,}\b"), F.lit(0))
    kinds = F.array_max(F.transform(formulas, lambda f: F.size(F.array_distinct(F.regexp_extract_all(f, F.lit("[A-Z][a-z]?"), F.lit(0))))))
    mismatch = (ratio != "") & F.contains(F.lower(full), F.lit("birikma")) & (F.size(F.split(ratio, ":")) > kinds)
    lost = F.contains(F.lower(text), F.lit("oksidlan")) & text.rlike(r"\bC?H?[0-9]*\(?CH") & ~F.contains(text, F.lit("=")) & ~F.contains(text, F.lit("≡"))
    checks = [
        ("repeated_element", full.rlike(r"\b([A-Z][a-z]?)[0-9]*\1[0-9]*\b")),
        ("empty_equation_side", text.rlike(r"(?m)^[ \t]*=|=[ \t]*$")),
        ("dangling_product", text.rlike(r"(?i)\bva\s+hosil\s+bo")),
        ("ratio_element_mismatch", mismatch),
        ("possible_lost_bond", lost),
        ("ocr_confusion", F.array_contains(F.regexp_extract_all(F.lower(full), F.lit(r"\p{L}+"), F.lit(0)), "fill")),
        ("broken_isotope", full.rlike(r"\b[0-9]{4,6}[A-Z][a-z]?\b|\b[a-z][0-9]+α")),
        ("mangled_radical", full.rlike(r"\^\(?\s*[^\s()]*√")),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))


def lint(text: Column, options: Column, description: Column, answer: Column) -> Column:
    """What must not reach print."""
    long = lambda c: F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) >= 3))
    checks = [
        ("stem_starts_with_number", text.rlike(r"^\s*[0-9]+\s*[.)]\s")),
        ("desc_echoes_stem", overlap(long(description), long(text)) >= 0.7),
        ("desc_reveals_answer", reveals_answer(description, answer)),
        ("options_inside_stem", (F.size(options) >= 4) & text.rlike(r"\bA\)") & text.rlike(r"\bB\)")),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))


def mixed_case(letters: Column) -> Column:
    """Upper and lower case labels in one set."""
    upper = F.exists(letters, lambda x: (x == F.upper(x)) & (x != F.lower(x)))
    return upper & F.exists(letters, lambda x: (x == F.lower(x)) & (x != F.upper(x)))


def skip_numbers(text: Column) -> Column:
    """Numbers marked to be skipped, as in '47-'."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|\s)([0-9]{1,3})-(?=\s|$)"), F.lit(1)), lambda n: n.cast("int"))


def parse_caption(text: Column) -> Column:
    """Name and variant: the first token of digits only is the variant, the rest the name."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    digits = F.filter(F.transform(parts, lambda t, i: F.when(t.rlike("^[0-9]+$"), i)), lambda i: i.isNotNull())
    at = F.get(digits, F.lit(0))
    name = F.array_join(F.filter(F.transform(parts, lambda t, i: F.when(at.isNull() | (i != at), t)), lambda t: t.isNotNull()), " ")
    return F.struct(F.nullif(name, F.lit("")).alias("name"), F.get(parts, at).try_cast("int").alias("variant"))


def scripted(runs: DataFrame) -> DataFrame:
    """Paragraph text with raised and lowered runs marked; more than one character goes into parentheses."""
    body = F.trim("text")
    wrapped = F.when(F.length(body) > 1, F.concat(F.lit("("), body, F.lit(")"))).otherwise(body)
    marked = F.when((F.col("style") == "super") & (body != ""), F.concat(F.lit("^"), wrapped)).when((F.col("style") == "sub") & (body != ""), F.concat(F.lit("_"), wrapped)).otherwise(F.col("text"))
    own = runs.groupBy("para").agg(F.array_sort(F.collect_list(F.struct("idx", marked.alias("t")))).alias("r"))
    return own.select("para", F.array_join(F.transform("r", lambda x: x["t"]), "").alias("text"))


def labels_hint(questions: DataFrame, by: str) -> DataFrame:
    """'1) abde' for each question, a pen where it has no options."""
    told = F.when(F.size("letters") > 0, F.lower(F.array_join("letters", ""))).otherwise(F.lit("✍️"))
    own = questions.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("question_number", F.concat(F.col("question_number").cast("string"), F.lit(") "), told).alias("t")))).alias("x"))
    return own.select(by, F.array_join(F.transform("x", lambda v: v["t"]), " · ").alias("hint"))


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_number(n / 1024, "0.0"), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / (1024 * 1024), "0.0"), F.lit(" MB")))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)
