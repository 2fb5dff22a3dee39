"""Prompts and generation: labelled chunks to training examples, each distinct text generated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import cache_key, word_count
from lexiloom.operators.corpus import assemble, expand
from lexiloom.operators.labeling import memoised
from lexiloom.plans.lineage import materialise

# What a model is asked for each framing, and for a label, about a passage {content}.
ASK = {
    "QA": "PASSAGE:\n{content}\n\nQ: Given the observations described above, what does the detective conclude, and how does he arrive at that conclusion?\n\nWrite only the answer — begin directly with the detective's reasoning:",
    "WATSON": "PASSAGE:\n{content}\n\nWrite Watson's retrospective account of this scene:",
    "CHAIN": "PASSAGE:\n{content}\n\nExtract the reasoning chain. Fill in the structured analysis, beginning with the first observable fact:\n1.",
    "REVERSE": "PASSAGE:\n{content}\n\nState the detective's main conclusion, then write the question:",
}
# What a model is told to be for each framing, and for a label.
TELL = {
    "QA": "You write companion documents for Victorian detective fiction. Given a story passage, produce a first-person answer in the detective's voice explaining exactly how he reasoned from his observations to his conclusion. Be specific about each observation and the inference it supports. Maintain Victorian register and formal sentence structure. Respond with only the answer text — no preamble, no meta-commentary.",
    "WATSON": "You write from the perspective of Dr. John Watson. Given a scene from a Victorian detective story, write a retrospective account in Watson's voice: past tense, 3–5 sentences. Emphasise what Holmes noticed, what Watson initially missed, and what the experience revealed about Holmes's method. Respond with only Watson's account — no preamble, no meta-commentary.",
    "CHAIN": "You produce structured analyses of Victorian detective reasoning. Given a passage, extract the observable facts and the inferences drawn from them, then state the final conclusion. Respond with numbered OBSERVATIONS, numbered INFERENCES, and a CONCLUSION line. Start your response directly with '1.' for the first observation — no preamble.",
    "REVERSE": "You restate Victorian detective conclusions. Given a passage, identify the detective's main conclusion and state it as a single direct sentence prefixed exactly 'CONCLUSION: '. Then on the next line write exactly this question: 'What observations would you expect a skilled detective to have made in order to reach this conclusion?' Nothing else — no explanation, no preamble, no passage reproduction.",
}
TELL_LABEL = "You classify passages from Sherlock Holmes stories. Respond ONLY with a LABEL line and a JUSTIFICATION line. No other text."
ASK_LABEL = "Passage:\n{content}\n\n{question}\n\nRespond in exactly this format (nothing else):\nLABEL: <none|minor|central>\nJUSTIFICATION: <one sentence explaining your choice>"


def fill(template: str, content: Column, **more: str) -> Column:
    """The template with the passage in it. Pieces are joined, since a passage may hold the template's marks."""
    for name, text in more.items():
        template = template.replace(f"{{{name}}}", text)
    before, after = template.split("{content}")
    return F.concat(F.lit(before), content, F.lit(after))


def label_prompt(content: Column, question: str) -> Column:
    return fill(ASK_LABEL, content, question=question)


def framing_prompt(framing: Column, content: Column) -> Column:
    """The question for a framing; null for one that asks nothing."""
    out = F.lit(None).cast("string")
    for name, template in ASK.items():
        out = F.when(framing == name, fill(template, content)).otherwise(out)
    return out


def messages(system: Column, user: Column) -> Column:
    """What is sent to a model: a system message and a user's; null where nothing is asked."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.when(system.isNotNull() & user.isNotNull(), F.array(message("system", system), message("user", user)))


def label_messages(content: Column, question: str) -> Column:
    return messages(F.lit(TELL_LABEL), label_prompt(content, question))


def framing_messages(framing: Column, content: Column) -> Column:
    """The messages for a framing; null for one that asks nothing."""
    system = F.lit(None).cast("string")
    for name, text in TELL.items():
        system = F.when(framing == name, text).otherwise(system)
    return messages(system, framing_prompt(framing, content))


def augment(
    labelled: DataFrame, cache: DataFrame, provider, model: str, version: str, oversample: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Examples, failed rows and new cache rows (key, answer) of chunks (label, content, word_count and others).

    A text is generated once for its framing, whatever the number of copies; failures are not kept, so they are tried again
    the next time. The key says neither copy nor temperature. word_count becomes that of the example.
    """
    # read three times below, so the chunks are not cut again for each
    rows = materialise(
        expand(labelled, oversample).withColumns(
            {
                "key": cache_key(F.lit(model), F.lit(version), F.col("framing"), F.col("content")),
                "prompt": framing_prompt(F.col("framing"), F.col("content")),
            }
        )
    )
    asked, fresh = memoised(rows.where("prompt is not null"), "key", "prompt", cache, provider, keep_failures=False)
    plain = rows.where("prompt is null").withColumns(
        {"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "cached": F.lit(True)}
    )
    both = asked.unionByName(plain).withColumn(
        "text", assemble(F.col("framing"), F.col("content"), F.col("answer"))
    ).drop("key", "prompt", "answer", "error")
    return both.where("text is not null").withColumn(
        "word_count", word_count(F.col("text"))
    ), both.where("text is null").drop("text"), fresh
