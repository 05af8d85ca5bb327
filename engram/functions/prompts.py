"""Texts for the text model, as Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.models import MATERIAL

FACTS = "List the facts that these related passages state: people, events, preferences and dates. One sentence a line, each behind '- '."
PROFILE = "Describe the user of this dialogue in one paragraph. Then write the line {marker} and list what is private to the user, one fact a line."
TRAITS = "List what this dialogue shows about the assistant, one fact a line."
KEYWORDS = "Name up to three keywords of this text, separated by commas, and nothing else."
MERGE = "Merge both descriptions of one user; where they disagree, the second holds."
#: The reply to PROFILE is cut here.
MARKER = "[PRIVATE]"
CONTAINS = "Decide whether the reply contains the reference answer. Equivalent wording counts, a part of the answer does not."
JUDGE = {
    "single-session-user": CONTAINS,
    "single-session-assistant": CONTAINS,
    "multi-session": CONTAINS,
    "temporal-reasoning": CONTAINS + " A count of days, weeks or months may be off by one.",
    "knowledge-update": "Decide whether the reply gives the updated answer. Older values beside it do no harm.",
    "single-session-preference": "Decide whether the reply serves the user as the rubric asks. It need not meet every point, but must use what is known of the user.",
}
ANY = "Decide whether the reply agrees with the reference answer."
ABSTAIN = "The question can't be answered. Decide whether the reply says so."


def about(instruction: str, material: Column) -> Column:
    return F.concat(F.lit(f"{instruction}\n\n{MATERIAL}\n"), material)


def judge(task: Column, question: Column, answer: Column, reply: Column, abstention: Column) -> Column:
    """Yes/no question for the judge; the rule follows the question type, and abstention goes first."""
    rule = F.when(abstention, ABSTAIN)
    for name, text in JUDGE.items():
        rule = rule.when(task == name, text)
    parts = [F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in (("Question", question), ("Reference", answer), ("Reply", reply))]
    return F.concat_ws("\n\n", rule.otherwise(ANY), *parts, F.lit("Answer yes or no."))
