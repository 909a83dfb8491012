"""The registered queries of this subpackage; each applies its operator to a whole given table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from statloom.catalog.registry import query, table
from statloom.llm import bpe, embeddings, imatch, licenses, mixing, negatives, ngram_join, pii, quality, search, token_counts, url_lm, warc
from statloom.operators.stage import Stage


@query("op1_embedding_dedup")
def op1_embedding_dedup(spark, sf):
    """Links and groups of all embeddings."""
    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


@query("op2_bpe")
def op2_bpe(spark, sf):
    """Ids and decoded text of every document, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path), path)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_warc_revisits", warc.crawl_sql())
def op3_warc_revisits(spark, sf):
    """The not-modified answers of a crawl of all pages, resolved."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    found = warc.resolve_revisits(warc.crawl_of(pages))
    return found.withColumn("headers", warc.headers_text(F.col("headers")))


@query("op4_imatch")
def op4_imatch(spark, sf):
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return imatch.edit_report(table(spark, sf, "documents"))


#: Sources and topics are evened out, languages get fixed shares; half of the tokens are kept.
MIX_TARGETS = {"source": 0.7, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": 0.9}
MIX_FRACTION = 0.5


@query("op5_mixing", mixing.mix_sql(MIX_TARGETS, MIX_FRACTION))
def op5_mixing(spark, sf):
    """Every document's probability and whether the sample holds it."""
    # The texts are read once; what mixing needs of them is written.
    docs = Stage(spark, "mixing-input").put(mixing.described(table(spark, sf, "documents"), "doc_id", "source", "lang"), "documents")
    mixed = mixing.with_probability(docs, MIX_TARGETS, MIX_FRACTION, columns={"topic": F.col("topic")}, tokens=F.col("n_tokens"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


@query("op6_quality")
def op6_quality(spark, sf):
    """A quality score of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf, "labels").filter(~quality.held_out("doc_id")))
    scored = quality.classify(docs, model).withColumn("held_out", quality.held_out("doc_id"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op8_ngram_join")
def op8_ngram_join(spark, sf):
    """The near-duplicate group of every document."""
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


#: In production the key comes from a secret store.
PII_KEY = "surrogate-key-of-the-given-tables"


@query("op7_pii")
def op7_pii(spark, sf):
    """Every document with its personal data replaced."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return pii.replace_entities(docs, PII_KEY)


#: The rules of the URL query.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


@query("op9_url_filter", url_lm.judge_sql(URL_RULES))
def op9_url_filter(spark, sf):
    """A verdict for every page's URL."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_lm.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op10_token_counts")
def op10_token_counts(spark, sf):
    """Token counts of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(docs, path).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op11_ranked_search", search.search_sql())
def op11_ranked_search(spark, sf):
    """The ten best documents of every benchmark item."""
    return search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_hard_negatives", negatives.mine_sql())
def op12_hard_negatives(spark, sf):
    """The hard negatives of every fiftieth vector, one label in seven moved."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op13_license_scan")
def op13_license_scan(spark, sf):
    """The licences that every document names."""
    found = licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
