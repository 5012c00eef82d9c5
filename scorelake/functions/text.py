"""Text expressions: parsers of model outputs, tokens, labels, escapes. All are JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.split and str.strip know it (fixed set of code points).
SPACE = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def tokens(c: Column) -> Column:
    """Lower-case words between white space; a null has none."""
    return F.filter(F.split(F.coalesce(F.lower(c), F.lit("")), f"{SPACE}+"), lambda t: t != "")


def choice_letter(c: Column) -> Column:
    """The last letter A to J that stands alone in the upper-cased text; "" if there is none."""
    return F.coalesce(F.regexp_extract(F.upper(c), r"(?s)^(?:.*[^\p{L}\p{N}_])?([A-J])(?:[^\p{L}\p{N}_].*)?$", 1), F.lit(""))


def math_answer(c: Column) -> Column:
    """What stands in the last \\boxed{…} without braces inside, else the whole text; white space around it removed."""
    boxed = F.regexp_extract_all(c, F.lit(r"\\boxed\{([^{}]+)\}"), 1)
    return stripped(F.coalesce(F.try_element_at(boxed, F.lit(-1)), c))


def code_block(c: Column) -> Column:
    """The last fenced code block, else the whole text; white space around it removed."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?is)```(?:python|py|cpp|c\+\+)?\s*(.+?)\s*```"), 1)
    return stripped(F.coalesce(F.try_element_at(blocks, F.lit(-1)), c))


def code_text(value: Column) -> Column:
    """Code of an output in JSON text: of an object the first non-blank string member of solution, code and answer,
    otherwise of the text itself."""
    held = F.coalesce(*(F.when(stripped(F.get_json_object(value, f"$.{k}")) != "", F.get_json_object(value, f"$.{k}")) for k in ("solution", "code", "answer")))
    return code_block(F.coalesce(held, value))


def math_text(c: Column) -> Column:
    return F.lower(stripped(F.replace(c, F.lit(" "), F.lit(""))))


def answer_text(expected_json: Column, key: str) -> Column:
    """The member ``key`` of a JSON object, or the JSON string or value itself; null if there is none."""
    is_object = F.startswith(F.ltrim(expected_json), F.lit("{"))
    plain = F.get_json_object(F.concat(F.lit("["), expected_json, F.lit("]")), "$[0]")
    return F.when(is_object, F.get_json_object(expected_json, f"$.{key}")).otherwise(plain)


def expected_text(expected_json: Column, key: str) -> Column:
    """answer_text, with "" for null."""
    return F.coalesce(answer_text(expected_json, key), F.lit(""))


def pass_fail_score(label: Column) -> Column:
    """1 for pass, yes, correct, true and 1; 0 for their opposites; a number for itself; else 0."""
    return (
        F.when(label.isin("pass", "yes", "correct", "true", "1"), 1.0)
        .when(label.isin("fail", "no", "incorrect", "false", "0"), 0.0)
        .otherwise(F.coalesce(F.when(label.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), label.try_cast("double")), F.lit(0.0)))
    )


def pairwise_score(label: Column) -> Column:
    return F.when(label == "a", 1.0).when(label == "tie", 0.5).otherwise(0.0)


def first_word(c: Column) -> Column:
    """The first word in lower case; null if the text is null or blank."""
    return F.try_element_at(tokens(c), F.lit(1))


#: Replacements for LaTeX, in this order (fixed values).
LATEX = [("\\", "\\textbackslash{}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("{", "\\{"), ("}", "\\}"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}")]


def latex_escaped(c: Column) -> Column:
    """The text for a LaTeX table; "" for null. Marks stand in for the replacements, so none is escaped twice."""
    text = F.coalesce(c, F.lit(""))
    for i, (mark, _) in enumerate(LATEX):
        text = F.replace(text, F.lit(mark), F.lit(chr(0xE000 + i)))
    for i, (_, shown) in enumerate(LATEX):
        text = F.replace(text, F.lit(chr(0xE000 + i)), F.lit(shown))
    return text


def choice_label(index: Column) -> Column:
    """A to Z, then AA to ZZ, AAA and so on: the label of option ``index``, from 0, of any INT."""
    letters = lambda rest, n: F.concat(*(F.char(((F.floor(rest / 26**k) % 26) + 65).cast("int")) for k in reversed(range(n))))
    start, found = 0, None
    for n in range(1, 8):  # the labels of n letters begin at ``start``
        label = letters(index - start, n)
        found = F.when(index < start + 26**n, label) if found is None else found.when(index < start + 26**n, label)
        start += 26**n
    return found


#: Wording of a multiple-choice prompt (fixed values).
QUESTION, OPTIONS, LETTER_ONLY = "Question:\n", "\n\nOptions:\n", "\n\nReturn the best option letter only."


def choice_prompt(question: Column, options: Column) -> Column:
    """A multiple-choice prompt with labelled options."""
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(choice_label(i), F.lit(". "), o)), "\n")
    return F.concat(F.lit(QUESTION), question, F.lit(OPTIONS), lines, F.lit(LETTER_ONLY))
