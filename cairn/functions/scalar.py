"""Column functions. Python's notion of white space and digits is Unicode's, so the patterns say (?U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import schema as S


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_key(c: Column) -> Column:
    return F.lower(strip(c))


def is_chinese(c: Column) -> Column:
    return c.rlike("[\\u4e00-\\u9fff]")


def starts_with_digit(c: Column) -> Column:
    """As str.isdigit has it: decimal digits of any script, superscripts, subscripts and circled digits."""
    return c.rlike("^[\\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]")


def truncate(c: Column, most: int = 600) -> Column:
    return F.concat(F.substring(c, 1, most), F.when(F.char_length(c) > most, "…").otherwise(""))


def count_of(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a non-empty term."""
    return ((F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))) / F.char_length(term)).cast("long")


def clean_page(text: Column, sep: str = "\n") -> Column:
    """Drop lines of page numbers and dots: only digits, blanks and bullets, at most six characters when trimmed."""
    lines = F.filter(F.split(text, sep), lambda x: ~(strip(x).rlike(r"(?U)^[·•\d\s]+$") & (F.char_length(strip(x)) <= 6)))
    return F.array_join(lines, sep)


def chunks(text: Column, most: int = 3000, sep: str = r"\n{2,}") -> Column:
    """Paragraphs packed greedily into chunks of about `most` characters; a paragraph is never cut."""
    paras = F.filter(F.transform(F.split(text, sep), strip), lambda x: x != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def pack(acc: Column, para: Column) -> Column:
        full = (F.char_length(acc["cur"]) + F.char_length(para) + 1 > most) & (acc["cur"] != "")
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["cur"] == ""), para).otherwise(F.concat(acc["cur"], F.lit("\n\n"), para)).alias("cur"),
        )

    return F.aggregate(paras, empty, pack, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))))


def chapter_heading(line: Column) -> Column:
    """struct(number, title) of a line like 第三章 …, else null. Numerals are single characters; others are no heading."""
    pattern = r"(?U)^第([一二三四五六七八九十]+)章\s*(.+)"
    numeral = F.regexp_extract(line, pattern, 1)
    title = F.regexp_replace(F.regexp_extract(line, pattern, 2), r"(?U)\s", "")
    ok = (F.char_length(numeral) == 1) & F.char_length(title).between(1, 20)
    return F.when(ok, F.struct(number_of(numeral).alias("number"), title.alias("title")))


def number_of(numeral: Column) -> Column:
    return F.call_function("instr", F.lit("一二三四五六七八九十"), numeral)


def split_exercises(text: Column) -> Column:
    """struct(body, exercises): cut at the first line that says 习题. Null has a null body and no exercises."""
    body = F.get(F.split(text, r"(?U)\n\s*习\s*题\s*\n", 2), 0)
    return F.struct(body.alias("body"), F.coalesce(F.substring(text, F.char_length(body) + 1, F.char_length(text)), F.lit("")).alias("exercises"))


def chunk_id(stem: Column, chapter: Column, i: Column) -> Column:
    return F.format_string("%s_%s_C%03d", stem, chapter, i)


def pid_prefix(chapter: Column, number: Column) -> Column:
    return F.when(number.isNotNull(), F.concat(F.lit("CH"), number.cast("string"))).otherwise(F.substring(F.regexp_replace(chapter, r"(?U)\W", ""), 1, 8))


def weight_tenths(depth: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(depth == kv[0], kv[1]), list(S.WEIGHT_TENTHS.items())[1:], F.when(depth == 0, S.WEIGHT_TENTHS[0])).otherwise(S.FAR_WEIGHT_TENTHS)


def risk(mastery: Column) -> Column:
    return F.when(mastery < S.HIGH_BELOW, "high").when(mastery < S.MEDIUM_BELOW, "medium").otherwise("low")


def risk_order(r: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, S.RISKS)), r).cast("int") - 1, F.lit(3))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def distance_score(d: Column) -> Column:
    return 1 / (1 + d)


def node_size(degree: Column, base: float, factor: float, most: float) -> Column:
    return F.least(F.lit(most), F.lit(base) + F.log2(degree + 1) * factor)


def keyword_class(name: Column, classes: dict[str, list[str]], default: str) -> Column:
    """The first class one of whose keywords the name contains."""
    out = F
    for label, keys in classes.items():
        out = out.when(reduce(lambda a, b: a | b, [name.contains(k) for k in keys]), label)
    return out.otherwise(default) if classes else F.lit(default)


def parse_csv(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.replace(c, F.lit("，"), F.lit(",")), ","), strip), lambda x: x != "")


def format_accuracy(c: Column) -> Column:
    return F.when(c.isNull(), "N/A").otherwise(F.format_string("%.2f%%", c * 100))


def percent_bar(pct: Column) -> Column:
    return F.repeat(F.lit("█"), (pct / 5).cast("int"))


def fenced_json(text: Column) -> Column:
    """A VARIANT: the text itself if it is JSON, else the first fenced block that is."""
    block = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(block))


# Fixed texts of the reports: they must come out letter by letter.
def trace_reason(name: Column, depth: Column, pid: Column, target: Column) -> Column:
    return F.when(depth == 0, F.concat(F.lit("错题 "), pid, F.lit(" 直接考查「"), target, F.lit("」，「"), name, F.lit("」本身可能未掌握。"))).otherwise(
        F.concat(F.lit("错题 "), pid, F.lit(" 考查「"), target, F.lit("」，「"), name, F.lit("」是其第 "), depth.cast("string"), F.lit(" 层先修概念，可能是错误根因。"))
    )


def aggregate_reason(hits: Column, targets: Column) -> Column:
    return F.concat(F.lit("该概念被 "), hits.cast("string"), F.lit(" 条错题证据命中，关联考查概念包括「"), F.array_join(targets, "、"), F.lit("」，建议优先排查。"))


def mastery_reason(name: Column, pids: Column, targets: Column, weakness: Column, risk_: Column, correct: Column) -> Column:
    wrong = F.when(F.size(pids) > 0, F.concat(F.lit("概念「"), name, F.lit("」由错题 "), F.array_join(pids, ", "), F.lit(" 命中，关联考查概念包括「"), F.array_join(targets, "、"), F.lit("」"))).otherwise(
        F.concat(F.lit("概念「"), name, F.lit("」暂无错题命中"))
    )
    right = F.when(F.size(correct) > 0, F.concat(F.lit("；但正确题 "), F.array_join(correct, ", "), F.lit(" 提供了反证，因此已适当下调薄弱分"))).otherwise("")
    return F.concat(wrong, F.lit("，weakness="), weakness.cast("string"), F.lit("，风险等级为 "), risk_, right, F.lit("。"))


def plan_reason(name: Column, is_weak: Column, prerequisite_of: Column, risk_: Column, mastery: Column) -> Column:
    base = (
        F.when(is_weak, F.concat(F.lit("「"), name, F.lit("」是诊断出的薄弱概念，需要直接复习。")))
        .when(F.size(prerequisite_of) > 0, F.concat(F.lit("「"), name, F.lit("」是「"), F.array_join(prerequisite_of, "、"), F.lit("」的先修概念，应先补齐基础。")))
        .otherwise(F.concat(F.lit("「"), name, F.lit("」位于当前薄弱概念的先修链上，建议复习。")))
    )
    known = F.when(risk_.isNotNull() & (risk_ != "unknown"), F.concat(F.lit(" 当前风险等级为 "), risk_, F.lit("。"))).otherwise("")
    rated = F.when(mastery.isNotNull(), F.concat(F.lit(" 估计掌握度为 "), mastery.cast("string"), F.lit("。"))).otherwise("")
    return F.concat(base, known, rated)
