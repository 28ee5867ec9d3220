"""The registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import op01_fertility, op02_lines, op04_tokens, op05_language, op06_chat, op07_jaccard, op08_substrings, op09_cotrain, op11_repair, op12_trie, op13_sketch
from quadrille.llm import op03_decontaminate as decontamination
from quadrille.llm import op10_mixing as mixing
from quadrille.llm.common import table


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_fertility.fertility(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op02_lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_tokens.token_digests(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages. Pages have page_id and, as doc_id, -1 - page_id."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    langs, logp = op05_language.train(docs)
    rows = op05_language.from_documents(docs).unionByName(op05_language.from_pages(pages).withColumn("doc_id", -1 - F.col("page_id")), allowMissingColumns=True)
    return op05_language.identify(rows, langs, logp, "doc_id long, page_id long")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    chats = op06_chat.format_chats(rows.unionByName(more))
    turns, loss = op06_chat.read_turns("formatted"), op06_chat.read_loss("segments")
    chats = chats.withColumn("turns", turns).withColumn("loss", loss)
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_jaccard.jaccard_join(table(spark, sf_dir, "documents"))[0]


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op08_substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents"))


def op11_repair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = op11_repair.digest(op11_repair.repair(op11_repair.damage(rows)))
    ids = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").withColumn("conv_id", F.col("id")).drop("id")
    return out.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).withColumns({"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, turns = op12_trie.rebuild(op12_trie.ordered(table(spark, sf_dir, "conversations")))
    nodes, members = op12_trie.trie(convs, turns)
    out = nodes.join(op12_trie.ends_digest(members), op12_trie.KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: cells_edited and cells_next, the sizes of the sketches that held the differences."""
    rows = op13_sketch.with_next(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    out = op13_sketch.compare(rows, "text", ["edited", "next_text"], "doc_id long, n_chars long, edited_sha256 string")
    near = {f"near_{x}": op13_sketch.likeness("text", y) for x, y in (("edited", "edited"), ("next", "next_text"))}
    sizes = {"cells_edited": F.col("edited_cells"), "cells_next": F.col("next_text_cells")}
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("text_fingerprint").alias("fingerprint"), "edited_fingerprint", *[v.alias(k) for k, v in (near | sizes).items()])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_fertility, op2_line_dedup, op3_decontaminate, op4_tokens, op5_language, op6_chat, op7_jaccard_join, op8_substring_dedup, op9_cotraining, op10_mixing, op11_repair_turns, op12_prefix_trie, op13_fingerprint, pipeline)}


def _chat_sql() -> str:
    t = op06_chat.DEFAULT
    escaped = "replace(text, '\\', '\\\\')"
    for m in t.control:
        escaped = f"replace({escaped}, '{m}', '{m[0]}\\{m[1:]}')"
    marks = " ".join(f"WHEN '{r}' THEN {len(x[0]) + len(x[1])}" for r, x in t.turns.items())
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id {order}) AS k, lag(role) OVER (PARTITION BY conv_id {order}) AS prev FROM r),
o AS (SELECT *, CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user'
  WHEN prev = 'user' THEN role = 'assistant' WHEN prev = 'assistant' THEN role = 'user' ELSE false END AS fits FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(t.begin)} + sum(length({escaped}) + CASE role {marks} ELSE {sum(map(len, t.other))} + length({escaped.replace('(text,', '(role,')}) END))::BIGINT AS formatted_chars,
  bool_and(fits) AND arg_max(role, k) = 'assistant' AS valid
FROM o GROUP BY conv_id"""


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

_LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM l),
d AS (SELECT doc_id, i FROM u WHERE unit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, true AS gone FROM d UNION SELECT doc_id, i + 1, true FROM d),
k AS (SELECT doc_id, count(*) AS n_lines, count(gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL), '')) AS kept_sha256 FROM l LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept_sha256 FROM documents LEFT JOIN k USING (doc_id)"""

#: Items of 13 words and more have four words in a row right in each window that agrees; shorter ones are met by single words.
_OVERLAP_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
iw AS (SELECT row_number() OVER (ORDER BY item_id, text) AS item, item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
i AS (SELECT item, item_id, ws, len(ws) AS n, least(13, len(ws)) AS width, CASE WHEN len(ws) >= 13 THEN 4 ELSE 1 END AS run FROM iw WHERE len(ws) > 0),
ig AS (SELECT item, p, array_to_string(ws[p:p + run - 1], ' ') AS g, run FROM (SELECT *, unnest(range(1, n - run + 2)) AS p FROM i)),
dg AS (SELECT doc_id, p, run, array_to_string(ws[p:p + run - 1], ' ') AS g FROM (SELECT doc_id, ws, run, unnest(range(1, len(ws) - run + 2)) AS p FROM dw, (SELECT DISTINCT run FROM i))),
c AS (SELECT DISTINCT doc_id, item, dg.p - ig.p AS shift FROM dg JOIN ig USING (g, run)),
o AS (SELECT c.*, dw.ws AS a, i.ws AS b, n, width, item_id, greatest(shift, 0) + 1 AS lo, least(len(dw.ws), shift + n) AS hi FROM c JOIN dw USING (doc_id) JOIN i USING (item)),
m AS (SELECT doc_id, item, item_id, shift, width, q FROM (SELECT *, unnest(range(lo, hi + 1)) AS q FROM o WHERE hi - lo + 1 >= width) WHERE a[q] = b[q - shift]),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS near, count(*) OVER (PARTITION BY doc_id, item, shift) AS n_matched FROM m),
f AS (SELECT DISTINCT doc_id, item_id, n_matched FROM k WHERE near * 100 >= width * 80),
r AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max({'n': n_matched, 'i': item_id}) AS best FROM f GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, best.i AS item_id, best.n AS n_matched FROM documents LEFT JOIN r USING (doc_id)"""

_JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS sig FROM s GROUP BY doc_id),
k AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY sig) AS class_id FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
t AS (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(class_id, d.doc_id) AS class_id, coalesce(component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)"""

_REPEATS_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
u AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
d AS (SELECT doc_id, i FROM u QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
x AS (SELECT DISTINCT doc_id, i + j AS i, true AS gone FROM d, range(20) t(j)),
o AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT doc_id, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone IS NULL) AS kept FROM o LEFT JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

def _crc(text: str) -> str:
    """crc32 of an ASCII text, by bytes, where the table `crc` is joined."""
    step = "xor(crc_of_byte[(xor(s, ascii(x)) & 255)::INT + 1], s >> 8)"
    return f"xor(list_reduce(string_split({text}, ''), lambda s, x: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


#: The remainder of each byte by the polynomial of crc32.
_CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS crc_of_byte FROM (SELECT i, list_reduce(range(8), lambda s, x: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, i) AS v FROM range(256) t(i)))"


def _repair_sql() -> str:
    """One row a conversation walks over its rows; a survivor is (cost, audit, repaired), the least of its candidates."""
    much, tr = 10**9, "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    add = lambda v, cost, op, text: f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{op}', 'r': {v}.r || {text}}}"
    user, helper = "['user:']", "['assistant:']"
    never = f"{{'c': {much}, 'a': '', 'r': []::VARCHAR[]}}"
    as_user = [add(v, 5, "I", user) for v in ("s0", "s1", "s3")]
    with_insert = f"least(s2, {', '.join(as_user)})"
    closed = f"SELECT w.* EXCLUDE (s0, s1, s2, s3), s0, s1, least(s2, {', '.join(as_user)}) AS s2, least(s3, {add('s2', 5, 'I', helper)}, {add(f'({with_insert})', 5, 'I', helper)}) AS s3"
    move = lambda v, to, ok: f"CASE WHEN fault IN ('blank', 'duplicate') OR NOT ({ok}) THEN {never} ELSE {to} END"
    keep = lambda v, ini: move(v, add(v, tr, "K", "[role || ':' || text]"), f"role[1] = '{ini}'")
    role = lambda v, name: move(v, add(v, f"1 + {tr}", "R", f"['{name}:' || text]"), "true")
    to_user = ", ".join(f for v in ("s0", "s1", "s3") for f in (keep(v, "u"), role(v, "user")))
    drop = lambda v: add(v, 2, "D", "[]::VARCHAR[]")
    return rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM o WHERE kind <> 0)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM d),
n AS (SELECT *, row_number() OVER t AS i, lag(role[1]) OVER t || role[1] AS pair,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM e WINDOW t AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n),
w AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {drop('s0')} AS s0, least({drop('s1')}, {keep('s0', 's')}) AS s1, least({drop('s2')}, {to_user}) AS s2, least({drop('s3')}, {keep('s2', 'a')}, {role('s2', 'assistant')}) AS s3
  FROM ({closed}, role, text, fault FROM (SELECT w.* REPLACE (f.i AS i), f.role, f.text, f.fault FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1) w)),
l AS (SELECT conv_id, least(s0, s3) AS b FROM ({closed} FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1) w)),
g AS (SELECT conv_id AS id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.r, chr(10))) AS repaired_sha256 FROM l LEFT JOIN g ON id IS NOT DISTINCT FROM conv_id"""


#: Paths are compared as whole lists of turns; what lies below a node shares a conversation with it.
_TRIE_SQL = f"""
WITH {_CRC_TABLE},
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY k) AS ds, list(strlen(text) ORDER BY k) AS bs FROM o GROUP BY conv_id),
h AS (SELECT conv_id, ds, bs, {_crc("conv_id::VARCHAR")} % 9 AS h FROM t, crc),
r AS (SELECT h.conv_id, coalesce(b.ds[1:h], []) || h.ds[h + 1:] AS ds, coalesce(b.bs[1:h], []) || h.bs[h + 1:] AS bs FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(ds) AS n, CASE WHEN d = 0 THEN '' ELSE md5(array_to_string(ds[:d], ',')) END AS node, CASE WHEN d = 1 THEN '' WHEN d > 1 THEN md5(array_to_string(ds[:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b
  FROM (SELECT *, unnest(range(len(ds) + 1)) AS d FROM r)),
v AS (SELECT node, any_value(up) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS saved, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '') AS ends FROM p GROUP BY node, d),
k AS (SELECT up AS node, count(*) AS n_children FROM v WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT DISTINCT x.node AS top, y.node FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.d >= x.d),
s AS (SELECT top AS node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a JOIN v USING (node) LEFT JOIN k USING (node) GROUP BY top)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN v u ON u.node = v.up"""

ORACLE_SQL = {"op2_line_dedup": _LINES_SQL, "op3_decontaminate": _OVERLAP_SQL, "op6_chat": _chat_sql(), "op7_jaccard_join": _JACCARD_SQL, "op8_substring_dedup": _REPEATS_SQL, "op11_repair_turns": _repair_sql(), "op12_prefix_trie": _TRIE_SQL}
