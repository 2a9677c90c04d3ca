"""Reading clusters: labels from terms, summaries, sentiment by a small lexicon, deterministic stand-ins for language models."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import wordlists as L
from ..skew import small

# A small lexicon of our own; it is not equivalent to any published one.
POSITIVE = frozenset("good great excellent love loved like happy helpful friendly easy fast reliable best better nice perfect amazing satisfied comfortable sturdy smooth polite clear fresh fair cheerful elegant refreshing".split())
NEGATIVE = frozenset("bad poor terrible hate hated slow expensive broken rude difficult worst worse awful disappointed frustrating useless unreliable stressful noisy dirty flimsy overpriced sluggish bland confusing careless tiring".split())
#: Topics that are summarised at most; more are refused.
MAX_TOPICS = 1000
# Labels too vague to keep.
VAGUE = frozenset("general miscellaneous other various mixed topic theme cluster responses feedback comments unknown misc".split())


def without_subsets(terms: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Terms whose words are not all contained in another kept term."""
    sets = [set(t.split()) for t, _ in terms]
    return [x for i, x in enumerate(terms) if not any(i != j and sets[i] < sets[j] for j in range(len(terms)))]


def phrase_label(terms: list[tuple[str, float]], most: int = 3, stopwords: frozenset[str] = frozenset()) -> str:
    """Greedy label of the heaviest terms, a phrase of n words weighing 1 + 0.3 (n - 1) times its own weight.

    Stop words are struck from a term first. A term counts if less than half of its words are said already, or if it is a phrase that
    adds a word. The label ends at ``most`` terms or most + 2 words; without any term it is empty.
    """
    bare = [([w for w in t.split() if w.lower() not in stopwords], weight) for t, weight in terms]
    ranked = sorted((x for x in bare if x[0]), key=lambda x: -x[1] * (1 + 0.3 * (len(x[0]) - 1)))
    said: set[str] = set()
    chosen: list[list[str]] = []
    for words, _ in ranked:
        low = {w.lower() for w in words}
        known = len(low & said)
        if known * 2 < len(low) or len(words) > 1 and known < len(words):
            chosen.append(words)
            said |= low
            if len(chosen) == most or sum(map(len, chosen)) >= most + 2:
                break
    return " ".join(w.title() for words in chosen or [x[0] for x in ranked[:1]] for w in words)


def label_stopwords(df: DataFrame, text_col: str, least: float = 0.7, most: int = 20, known: frozenset[str] = L.STOPWORDS) -> DataFrame:
    """(word, documents): blank-separated words longer than two letters in at least ``least`` of all texts, the most frequent ``most``; ties by word."""
    n = df.count()
    words = df.select(F.explode(F.array_distinct(F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(known) or [""])))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") >= least * n).orderBy(F.desc("documents"), "word").limit(most)


def representatives(doc_topics: DataFrame, texts: DataFrame, id_col: str, text_col: str, n: int = 3, width: int = 200) -> DataFrame:
    """(topic, place, id, weight, text): per topic the documents it weighs most in, texts cut to width; ties by id.

    Only documents whose strongest topic it is are its own. The top lists are cut by rank before the texts are joined.
    """
    top = doc_topics.select("id", (F.array_position("weights", F.array_max("weights")) - 1).cast("int").alias("topic"), F.array_max("weights").alias("weight"))
    best = top.filter("weight > 0").withColumn("place", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("weight"), "id")).cast("long")).filter(F.col("place") <= n)
    t = texts.select(F.col(id_col).alias("id"), F.when(F.length(text_col) > width, F.concat(F.substring(text_col, 1, width - 3), F.lit("..."))).otherwise(F.col(text_col)).alias("text"))
    return t.join(small(best), "id").select("topic", "place", "id", "weight", "text")


def word_label(terms: list[tuple[str, float]], most: int = 3) -> str:
    seen: list[str] = []
    for term, _ in sorted(terms, key=lambda x: (-x[1], x[0])):
        for w in term.split():
            if w not in seen:
                seen.append(w)
    return " / ".join(w.title() for w in seen[:most]) or "Unlabeled"


def confidence(terms: list[tuple[str, float]], documents: int, coherence: float | None = None, mixed: bool = False) -> float:
    """min(1, sum of weights / 2), lowered for few terms, few documents, low coherence, mixed sentiment; 0 without terms or documents."""
    if not terms or not documents:
        return 0.0
    c = min(1.0, sum(w for _, w in terms) / 2)
    c *= 0.9 if len(terms) < 2 else 1
    c *= 0.95 if documents <= 2 else 1
    c *= 0.85 if coherence is not None and coherence < 0.4 else 1
    return c * (0.9 if mixed else 1)


def interpret(
    topics: DataFrame, sizes: dict[int, int], stopwords: frozenset[str] = L.STOPWORDS, least: float = 0.005, style: str = "phrase",
    detected: frozenset[str] = frozenset(), documents: dict[int, list[str]] | None = None, moods: dict[int, dict] | None = None, strip_sentiment: bool = True,
) -> list[dict]:
    """One summary a topic: top 15 terms of enough weight, label, documents, sentiment, confidence, warnings. Topics are few: k rows.

    Struck out: terms made of stop words, of words detected as too common in the texts, and, on request, of mere sentiment words.
    documents: texts that stand for a topic (representatives); moods: rows of cluster_sentiment by topic.
    """
    gone = stopwords | detected | ((POSITIVE | NEGATIVE) if strip_sentiment else frozenset())
    out, rows = [], topics.orderBy("topic").limit(MAX_TOPICS + 1).collect()
    if len(rows) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    for r in rows:
        terms = [(t, w) for t, w in zip(r["terms"], r["weights"], strict=True) if w >= least and not all(x in gone for x in t.split())][:15]
        terms = without_subsets(terms)
        n = sizes.get(r["topic"], 0)
        mood = (moods or {}).get(r["topic"], {})
        coherence, mixed = mood.get("coherence"), bool(mood.get("mixed"))
        flags = (("no terms", not terms), ("no documents", n == 0), ("very few documents", 0 < n <= 2), ("few terms", 0 < len(terms) < 2), ("mixed sentiment", mixed), ("low coherence", coherence is not None and coherence < 0.4))
        label = (phrase_label(terms, 3, stopwords | detected) if style == "phrase" else word_label(terms)) or "Unlabeled"
        out.append({
            "topic": r["topic"], "label": label, "terms": terms, "documents": n, "representatives": (documents or {}).get(r["topic"], []), "sentiment": mood or None,
            "confidence": round(confidence(terms, n, coherence, mixed), 4), "interpretable": bool(terms and n), "warnings": [m for m, hit in flags if hit],
        })
    return out


def sentiment(text: Column) -> Column:
    """Struct (label, score, positive, negative, neutral) by the small lexicon, negations reversing the next word; NULL is neutral with score 1."""
    tokens = F.regexp_extract_all(F.regexp_replace(F.lower(text), "n't", " not"), F.lit(r"((?:(?:not|no|never) )?[a-z]{2,})"), F.lit(1))
    turned = lambda words: sorted(f"{n} {w}" for n in ("not", "no", "never") for w in words)
    words = tokens
    pos = F.size(F.filter(tokens, lambda w: w.isin(*sorted(POSITIVE), *turned(NEGATIVE)))).cast("double")
    neg = F.size(F.filter(tokens, lambda w: w.isin(*sorted(NEGATIVE), *turned(POSITIVE)))).cast("double")
    compound = (pos - neg) / F.sqrt((pos - neg) * (pos - neg) + 15.0)
    n = F.greatest(F.size(words).cast("double"), F.lit(1.0))
    label = F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")
    some = F.struct(label.alias("label"), F.round(F.abs(compound), 6).alias("score"), F.round(pos / n, 6).alias("positive"), F.round(neg / n, 6).alias("negative"), F.round(1 - (pos + neg) / n, 6).alias("neutral"))
    none = F.struct(F.lit("neutral").alias("label"), F.lit(1.0).alias("score"), F.lit(0.0).alias("positive"), F.lit(0.0).alias("negative"), F.lit(1.0).alias("neutral"))
    return F.when(text.isNull(), none).otherwise(some)


def analyze_sentiment(df: DataFrame, text_col: str, prefix: str = "sentiment") -> DataFrame:
    d = df.withColumn("_s", sentiment(F.col(text_col)))
    for f in ("label", "score", "positive", "negative", "neutral"):
        d = d.withColumn(f"{prefix}_{f}", F.col(f"_s.{f}"))
    return d.drop("_s")


def transformer_sentiment(df: DataFrame, text_col: str, model: str):
    """Scores by a transformer, loaded once a worker; needs the transformers package and a local model."""
    try:
        from transformers import pipeline  # noqa: F401
    except ImportError as e:
        raise RuntimeError("needs the transformers package; analyze_sentiment works without") from e

    @F.pandas_udf("label string, score double")
    def run(batches):
        import pandas as pd

        pipe = pipeline("sentiment-analysis", model=model)
        for s in batches:
            found = pipe(s.fillna("").tolist(), truncation=True)
            yield pd.DataFrame({"label": [x["label"] for x in found], "score": [x["score"] for x in found]})

    return df.withColumn("transformer", run(F.col(text_col)))


def cluster_sentiment(df: DataFrame, cluster_col: str, label_col: str = "sentiment_label") -> DataFrame:
    """(cluster, n, shares, mixed, coherence): mixed if both poles hold a quarter; coherence 1 - entropy / log2 3; NULL below 2 texts."""
    n = F.count(F.lit(1))
    c = df.groupBy(F.col(cluster_col).alias("cluster")).agg(n.alias("n"), *[(F.count_if(F.col(label_col) == k) / n).alias(k) for k in ("positive", "negative", "neutral")])
    h = sum((F.when(F.col(k) > 0, -F.col(k) * F.log2(k)).otherwise(0.0) for k in ("negative", "neutral")), F.when(F.col("positive") > 0, -F.col("positive") * F.log2("positive")).otherwise(0.0))
    mixed = (F.col("positive") >= 0.25) & (F.col("negative") >= 0.25)
    return c.select("cluster", "n", *[F.round(k, 6).alias(k) for k in ("positive", "negative", "neutral")], F.when(F.col("n") >= 2, mixed).alias("mixed"), F.when(F.col("n") >= 2, F.round(1 - h / F.log2(F.lit(3.0)), 6)).alias("coherence"))


def parse_answer(answer: str) -> dict:
    """label, description and alternatives of a model's answer: JSON, fenced or not, else labelled lines, else its first line."""
    body = re.sub(r"^```(?:json)?|```$", "", answer.strip(), flags=re.MULTILINE).strip()
    m = re.search(r"\{.*\}", body, re.DOTALL)
    if m:
        try:
            x = json.loads(m.group())
            return {"label": str(x.get("label", "")).strip(), "description": str(x.get("description", "")).strip(), "alternatives": list(x.get("alternatives", []))}
        except ValueError:
            pass
    fields = dict(re.findall(r"(?im)^\s*(label|description)\s*:\s*(.+)$", body))
    low = {k.lower(): v.strip() for k, v in fields.items()}
    first = next((line.strip() for line in body.splitlines() if line.strip()), "")
    return {"label": low.get("label", first).strip("\"' "), "description": low.get("description", ""), "alternatives": []}


def is_vague(label: str) -> bool:
    """Labels that are empty, one vague word, or vague words only."""
    words = re.findall(r"[a-z]+", label.lower())
    return not words or all(w in VAGUE for w in words)


def fallback_label(keywords: list[str]) -> dict:
    """What stands in for a language model: the first three keywords."""
    top = [k for k in keywords if k][:3]
    return {"label": " / ".join(k.title() for k in top) or "Unlabeled", "description": f"Responses about {', '.join(top)}" if top else "", "alternatives": [k.title() for k in keywords[3:6]]}
