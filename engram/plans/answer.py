"""Retrieval as read and write, prompts for answers and their judging."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.config import DEFAULT, MemoryConfig
from engram.functions import prompts as P
from engram.functions.models import completion, embedding, hashed_encoder, recalling_model
from engram.functions.text import abstains, frequent, judged, tokens, two_decimals
from engram.operators.knowledge import search_knowledge
from engram.plans.cache import ModelCache, with_replies
from engram.plans.rounds import sequential
from engram.plans.state import kept

INSTRUCTION = "Answer the question from the memories, as briefly as possible."


def listed(rows: DataFrame, key: str, order: str, text: str, name: str) -> DataFrame:
    """The texts of each key as a bullet list, in order."""
    parts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("l"))
    return parts.select(key, F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias(name))


def answer_prompts(questions: DataFrame, results: DataFrame, contents: DataFrame, profiles: DataFrame, knowledge: DataFrame, traits: DataFrame, c: MemoryConfig = DEFAULT) -> DataFrame:
    """(query_id, graph_id, prompt): memories in rank order, knowledge, profile and traits; sections without rows are left out.

    questions: query_id, graph_id, question, asked_on (may be null) and, where there are any, speakers (a list of names); contents: graph_id, node_id, content, ts;
    profiles: graph_id, data; knowledge: query_id, out_rank, content; traits: graph_id, seq, content.
    """
    r = results if c.flipped_in_context else results.where("NOT flipped")
    label = F.when(F.col("base_score") > 0.6, "Direct").otherwise("Associative")
    block = F.concat(F.lit("["), label, F.lit(", relevance "), two_decimals(F.col("score")), F.lit("]\n"), F.coalesce(F.concat(F.lit("Time: "), "ts", F.lit("\n")), F.lit("")), F.lit("Content: "), "content")
    m = r.join(contents, ["graph_id", "node_id"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("out_rank", block.alias("b")))).alias("l"))
    m = m.select("query_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("memories"))
    q = questions.join(m, "query_id", "left").join(listed(knowledge, "query_id", "out_rank", "content", "known"), "query_id", "left")
    q = q.join(profiles.select("graph_id", "data"), "graph_id", "left").join(listed(traits, "graph_id", "seq", "content", "traits"), "graph_id", "left")
    part = lambda head, col: F.concat(F.lit(f"{head}\n"), F.nullif(F.col(col), F.lit("")))
    sections = [part("About the assistant:", "traits"), part("About the user:", "data"), part("Knowledge:", "known"), part("Memories:", "memories"), F.concat(F.lit("Today: "), "asked_on")]
    if "speakers" in questions.columns:
        named = F.when(F.size("speakers") > 0, F.concat(F.lit("This is a conversation between "), F.array_join("speakers", " and "), F.lit(".")))
        sections.insert(0, named)
    return q.select("query_id", "graph_id", F.concat_ws("\n\n", F.lit(INSTRUCTION), *sections, F.concat(F.lit("Question: "), "question")).alias("prompt"))


def answers(prompts: DataFrame, make=recalling_model, cache: ModelCache | None = None) -> DataFrame:
    """The prompts with the model's answer, and why there is none where it failed."""
    return with_replies(prompts, F.col("prompt"), make, cache).withColumns({"answer": F.col("r.reply"), "error": F.col("r.error")}).drop("r")


def answer_questions(memory: tuple[DataFrame, DataFrame], knowledge: dict[str, DataFrame], asked: DataFrame, k: int = DEFAULT.top_k, kb_k: int = DEFAULT.kb_top_k,
                     c: MemoryConfig = DEFAULT, encode=hashed_encoder, make=recalling_model, cache: ModelCache | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, results, gains): what is retrieved from a graph's memories and its knowledge, its profile and the assistant's traits, in one prompt a question.

    asked: query_id, graph_id, qa_index, question, asked_on. ``knowledge`` is as ``load_knowledge`` gives it. Questions of
    a graph reinforce its memories in order, and gains are what its edges gain; knowledge is read only. Without memories there are no results, and the
    question is asked all the same.
    """
    q = asked.select("query_id", "graph_id", "qa_index", embedding(F.col("question"), encode).alias("q_embedding"), frequent(tokens(F.col("question")), 3).alias("q_keywords"))
    q = kept(q)
    nodes, edges = memory
    found, gains = sequential(nodes, edges, q, k, c)
    kb = knowledge["nodes"].select("graph_id", "node_id", "node_seq", "content", "embedding", "keywords")
    seen = search_knowledge(kb, knowledge["edges"], knowledge["fallback"], q.drop("qa_index"), kb_k, c)
    texts = kb.select("graph_id", "node_id", "content", F.lit("graph").alias("origin")).unionByName(knowledge["fallback"].select("graph_id", "node_id", "content", F.lit("fallback").alias("origin")))
    known = seen.join(texts, ["graph_id", "node_id", "origin"]).select("query_id", "out_rank", "content")
    traits = knowledge["assistant"].select("graph_id", F.col("ak_seq").alias("seq"), F.col("knowledge").alias("content"))
    prompts = answer_prompts(asked, found, nodes.select("graph_id", "node_id", "content", "ts"), knowledge["profiles"], known, traits, c)
    return answers(prompts, make, cache), found, gains


def judgements(rows: DataFrame, make) -> DataFrame:
    """rows: question_id, question_type, question, reference, answer. A failed reply counts as wrong."""
    ask = P.judge(F.col("question_type"), F.col("question"), F.col("reference"), F.col("answer"), abstains(F.col("question_id")))
    return rows.withColumn("correct", judged(completion(ask, make)))
