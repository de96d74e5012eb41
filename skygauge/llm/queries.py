"""One query per corpus operator, over its whole table, with production parameters."""

import public_tokenizers
from pyspark.sql import functions as F

from skygauge.llm import lang_id
from skygauge.llm.bpe import encode_decode
from skygauge.llm.common import table
from skygauge.llm.decontam import overlaps
from skygauge.llm.embed_dedup import embedding_dedup
from skygauge.llm.fill_middle import fill_in_middle
from skygauge.llm.registry import ORACLES, QUERIES, register  # noqa: F401
from skygauge.llm.html_extract import extract_text
from skygauge.llm.license_scan import scan_licenses
from skygauge.llm.lm_score import cross_entropy_difference
from skygauge.llm.mixing import mix, with_targets, words_taken
from skygauge.llm.secret_scan import find_secrets, listed
from skygauge.llm.simhash import simhash_dedup
from skygauge.llm.spelling import group_spellings
from skygauge.llm.token_count import count_tokens


@register("op4_token_counts")
def op4(spark, folder):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(table(spark, folder, "documents"), path).withColumnRenamed("id", "doc_id")


@register("op5_simhash_dedup")
def op5(spark, folder):
    found = simhash_dedup(table(spark, folder, "documents"))
    return found.select(found["id"].alias("doc_id"), "fingerprint", "component_id")


@register("op7_byte_bpe")
def op7(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode_decode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        coded["id"].alias("doc_id"), "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# A stretch with its allowed substitutions holds three equal words in a row, so common word
# triples name all diagonals that need a look. Short items stand whole after their first word.
_WORDS_SQL = r"""list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'),
    '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), ' '), lambda w: w <> '')"""
_OP10 = f"""WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
  items AS (SELECT DISTINCT item_id, {_WORDS_SQL} AS w FROM benchmark),
  b AS (SELECT row_number() OVER () AS i, item_id, w, least(13, len(w)) AS n, ceil(0.8 * least(13, len(w))) AS need
    FROM items WHERE len(w) >= 8),
  dt AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d),
  bt AS (SELECT i, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS t FROM b),
  d3 AS (SELECT doc_id, p, t, lead(t, 1) OVER o AS u, lead(t, 2) OVER o AS v FROM dt WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
  b3 AS (SELECT i, q, t, lead(t, 1) OVER o AS u, lead(t, 2) OVER o AS v FROM bt WINDOW o AS (PARTITION BY i ORDER BY q)),
  diagonal AS (SELECT DISTINCT doc_id, i, p - q AS shift FROM d3 JOIN b3 ON d3.t = b3.t AND d3.u = b3.u AND d3.v = b3.v),
  aligned AS (SELECT g.doc_id, g.i, g.shift, list(coalesce((dt.t = bt.t)::INT, 0) ORDER BY q) AS e
    FROM diagonal g JOIN bt ON g.i = bt.i LEFT JOIN dt ON dt.doc_id = g.doc_id AND dt.p = q + g.shift GROUP BY ALL),
  stretch AS (SELECT doc_id, i, shift, e, unnest(range(1, len(e) - n + 2)) AS s FROM aligned JOIN b USING (i)),
  scored AS (SELECT doc_id, item_id, n, need, s + shift AS first, list_sum(e[s:s + n - 1]) AS equal
    FROM stretch JOIN b USING (i) JOIN d USING (doc_id) WHERE s + shift >= 1 AND s + shift + n - 1 <= len(d.w)
    UNION ALL SELECT doc_id, item_id, len(s.w), len(s.w), p, len(s.w) FROM dt JOIN items s ON dt.t = s.w[1] AND len(s.w) < 8
    JOIN d USING (doc_id) WHERE d.w[p:p + len(s.w) - 1] = s.w)
SELECT doc_id, item_id, max(equal)::BIGINT AS n_equal, any_value(n)::BIGINT AS n_words,
  min(first - 1) FILTER (equal = top)::BIGINT AS first_word
FROM (SELECT *, max(equal) OVER (PARTITION BY doc_id, item_id) AS top FROM scored WHERE equal >= need) GROUP BY doc_id, item_id"""


@register("op10_decontamination", _OP10)
def op10(spark, folder):
    found = overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@register("op6_secret_scan")
def op6(spark, folder):
    found = find_secrets(table(spark, folder, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@register("op3_license_scan")
def op3(spark, folder):
    found = scan_licenses(table(spark, folder, "documents"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumnRenamed("id", "doc_id").withColumns(joined)


@register("op9_language_id")
def op9(spark, folder):
    documents = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = lang_id.train(documents.where(~held_out))
    found = lang_id.label_languages(documents, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_OP1 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
  reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) ON x = vec_id"""


@register("op1_embedding_dedup", _OP1)
def op1(spark, folder):
    return embedding_dedup(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")


@register("op8_lm_score")
def op8(spark, folder):
    good = table(spark, folder, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return cross_entropy_difference(table(spark, folder, "documents"), good).withColumnRenamed("id", "doc_id")


@register("op2_html_extraction")
def op2(spark, folder):
    found = extract_text(table(spark, folder, "pages"), F.struct("page_id", "url"))
    return found.select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"))


_OP12 = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), i, 8))::BIGINT) AS h FROM documents),
  c AS (SELECT *, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
  p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, len(u)::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256 FROM p"""


@register("op12_fill_in_middle", _OP12)
def op12(spark, folder):
    return fill_in_middle(table(spark, folder, "documents"), outputs=False).withColumnRenamed("id", "doc_id")


# The place of a row in its source's shuffle and the source's rounded target say what is taken of it.
_OP11 = r"""WITH d AS (SELECT doc_id, source, source IS NULL AS gone, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
  s AS (SELECT gone, source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY gone, source) - 1 AS rank FROM d GROUP BY gone, source),
  w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][rank % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
  l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
      - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM w WINDOW o AS (ORDER BY cap / weight, rank)),
  t AS (SELECT gone, source, source_size, least(cap, weight * (SELECT min_by(level, (cap / weight, rank)) FROM l WHERE level * weight <= cap)) AS target FROM l),
  p AS (SELECT d.*, source_size, target, pass, pass * source_size + coalesce(sum(size) OVER (PARTITION BY d.gone, d.source, pass
      ORDER BY md5('1:' || pass || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN t ON d.gone = t.gone AND d.source IS NOT DISTINCT FROM t.source, range(2) r(pass))
SELECT doc_id, size, source_size, target, sum(greatest(0, least(start + size, round(target)::BIGINT) - start))::BIGINT AS taken
FROM p GROUP BY doc_id, source, size, source_size, target"""


@register("op11_source_mixing", _OP11)
def op11(spark, folder):
    rows, spans, sources = mix(table(spark, folder, "documents"))
    taken = with_targets(words_taken(rows, spans), sources)
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@register("op13_spelling_variants")
def op13(spark, folder):
    return group_spellings(table(spark, folder, "documents"))
