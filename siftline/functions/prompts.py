"""Prompt templates, few-shot blocks and instruction items as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.numbers import fixed

# Texts of the instruction format.
DEFAULT_INSTRUCTION = "请分析以下测试用例，判断它是否是一个Flaky Test（不稳定测试），并说明你的推理过程。"
DEFAULT_INPUT = "该测试代码所属project的名称为{project}，它的测试名称为{test_name}，完整代码为{full_code}。"
SHOTS_HEAD = "\n\n参考案例（根据API签名相似度检索）：\n"
SHOTS_CODE_HEAD = "\n待分析的测试代码:\n"
CASE_HEAD, CASE_PROJECT, CASE_LABEL, CASE_CODE, CASE_END = "\n【案例 %d】(相似度: %s)\n", "项目: ", "\n标签: ", "\n代码:\n", "\n" + "-" * 60 + "\n"
SAMPLE_HEAD, SAMPLE_LABEL, SAMPLE_CODE, SAMPLE_END = "样本 ", ":\n标签: ", "\n代码:\n```\n", "\n```"
UNKNOWN = "Unknown"
PREVIEW = 200


def format_prompt(template: str, **values: Column) -> Column:
    """The template with its named fields filled in. It is split once, so braces in values stay as
    they are; a field without a value is a KeyError when the plan is made."""
    parts: list[Column] = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            parts.append(F.coalesce(values[field].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def code_preview(code: Column) -> Column:
    return F.substring(code, 1, PREVIEW)


def fewshot_block(cases: Column) -> Column:
    """Text of an array of cases (similarity, project, label, code), in order; the rank counts from 1."""
    case = F.transform(
        cases,
        lambda c, i: F.concat(
            F.format_string(CASE_HEAD, i + 1, fixed(c["similarity"])),
            F.lit(CASE_PROJECT), F.coalesce(c["project"], F.lit(UNKNOWN)),
            F.lit(CASE_LABEL), F.coalesce(c["label"], F.lit(UNKNOWN)),
            F.lit(CASE_CODE), c["code"], F.lit(CASE_END),
        ),
    )
    return F.concat(F.lit(SHOTS_HEAD + "=" * 60 + "\n"), F.array_join(case, ""))


def fewshot_insert(prompt: Column, code: Column, block: Column) -> Column:
    """The block before every occurrence of the code in the prompt; without cases the prompt as it is."""
    filled = F.replace(prompt, code, F.concat(block, F.lit(SHOTS_CODE_HEAD), code))
    return F.when(block.isNull() | (code == ""), prompt).otherwise(filled)


def explainer_sample(rank: Column, label: Column, code: Column) -> Column:
    return F.concat(F.lit(SAMPLE_HEAD), rank.cast("string"), F.lit(SAMPLE_LABEL), F.coalesce(label, F.lit(UNKNOWN)), F.lit(SAMPLE_CODE), code, F.lit(SAMPLE_END))


def explainer_samples(samples: Column) -> Column:
    """Sample texts joined by blank lines behind one rule of 60 dashes."""
    return F.concat(F.lit("\n\n" + "-" * 60), F.array_join(samples, "\n\n"))
