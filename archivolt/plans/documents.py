"""Queries on texts, pages and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import fields, fixed, pii, tables, text
from archivolt.operators import chunking, ocr
from archivolt.plans.catalog import query
from archivolt.plans.retrieval import NORM


def _re2(pattern: str) -> str:
    """A pattern with Unicode word characters spelled out, for engines where \\w is ASCII."""
    return pattern.replace("'", "''")


EMAIL, CARD = _re2(fixed.PII[2][1]), _re2(fixed.PII[4][1])
MASKED = "text"
for _, _p, _label in fixed.PII:
    MASKED = f"regexp_replace({MASKED}, '{_re2(_p)}', '{_label}', 'g')"


@query(f"SELECT id, {MASKED} AS masked FROM samples", "samples")
def pii_mask(t):
    return t.samples.select("id", pii.mask(F.col("text")).alias("masked"))


# The kinds of personal data with Unicode classes spelled out: W a word character, N any other, Z white space, D a digit.
# An end of a word is the next character or the text's end, which the replacement puts back; as two findings may share
# it, each is replaced twice. An address of mail begins and ends with a word character, so no boundary is needed.
W, N, Z, D = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}", r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]", r"\s\x0B\x1C-\x1F\x85\p{Z}", r"\p{Nd}"
WIDE_PII = [
    (rf"(^|{N})(?:{D}{{8}}[A-J]|[XYZ]{D}{{7}}[A-Z])($|{N})", r"\1[DNI]\2"),
    (rf"(?:\+34[{Z}-]?)?[6789]{D}{{2}}[{Z}.-]{D}{{3}}[{Z}.-]{D}{{3}}($|{N})", r"[TELEFONO]\1"),
    (rf"[{W}][{W}.+-]*@[{W}-]+\.[{W}.-]*[{W}]", "[EMAIL]"),
    (rf"(^|{N})(?:H[{Z}]?\.?C\.?|HC)[{Z}]?{D}{{4,}}($|{N})", r"\1[HISTORIA_CLINICA]\2"),
    (rf"([{W}]) Expediente [{Z}]?{D}{{4,}}($|{N})", r"\1[HISTORIA_CLINICA]\2"),
    (rf"(^|{N})(?:{D}[ -]*?){{12,15}}{D}($|{N})", r"\1[TARJETA]\2"),
    (rf"nacid[oa](?: el)?[{Z}]*:?[{Z}]*{D}{{1,2}}[/-]{D}{{1,2}}[/-]{D}{{2,4}}($|{N})", r"[FECHA_NACIMIENTO]\1"),
    (rf"(^|{N})(?:C/|Calle|Av\.?|Avenida|Paseo|Plaza)[{Z}]+[A-ZÁÉÍÓÚÑ][{W}]*(?:[{Z}]+[A-ZÁÉÍÓÚÑ][{W}]*)*[{Z}]*,?[{Z}]*(?:n[º°][{Z}]*)?{D}+($|{N})", r"\1[DIRECCION]\2"),
]
WIDE_MASKED = "text"
for _p, _label in WIDE_PII:
    for _ in range(2):
        WIDE_MASKED = f"regexp_replace({WIDE_MASKED}, '{_p}', '{_label}', 'g')"


@query(f"SELECT document_id, sha256({WIDE_MASKED}) AS masked FROM docs", "docs")
def pii_mask_documents(t):
    return t.documents.select("document_id", F.sha2(pii.mask(F.col("text")), 256).alias("masked"))


PII_ROWS = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, '{kind}' AS kind, '{label}' AS label, unnest(regexp_extract_all(text, '{_re2(p)}')) AS match FROM samples" for kind, p, label in fixed.PII) + ")"


@query(PII_ROWS, "samples")
def pii_detect(t):
    return pii.found(t.samples, "text").select("id", "kind", "label", "match")


@query(PII_ROWS, "samples")
def personal_data_function(t):
    """The same rows by the table function of SQL."""
    tables.register(t.spark)
    return t.spark.sql("SELECT s.id, p.kind, p.label, p.match FROM {samples} AS s, LATERAL personal_data(s.text) AS p", samples=t.samples)


def _counts(c: str) -> str:
    parts = []
    for _, p, label in fixed.PII:
        parts.append(f"len(regexp_extract_all({c}, '{_re2(p)}'))")
        c = f"regexp_replace({c}, '{_re2(p)}', '{label}', 'g')"
    return " + ".join(parts)


@query(f"SELECT id, CAST({_counts('text')} AS INTEGER) AS n FROM samples WHERE text IS NOT NULL", "samples")
def pii_counts(t):
    return t.samples.where("text is not null").select("id", pii.masked_count(F.col("text")).alias("n"))


@query("""SELECT id, CASE WHEN b IS NULL THEN NULL ELSE CASE WHEN age >= 0 THEN age END END AS age FROM (SELECT id, b, CAST(2025 - year(b) - CASE WHEN (6, 1) < (month(b), day(b)) THEN 1 ELSE 0 END AS INTEGER) AS age FROM (
SELECT id, CAST(try_strptime(lpad(CAST(CASE WHEN y < 100 THEN y + CASE WHEN y > 30 THEN 1900 ELSE 2000 END ELSE y END AS VARCHAR), 4, '0') || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0'), '%Y-%m-%d') AS DATE) AS b
FROM (SELECT id, TRY_CAST(regexp_extract(h, '(\\d{1,2})[/-](\\d{1,2})[/-](\\d{2,4})', 3) AS INTEGER) AS y, regexp_extract(h, '(\\d{1,2})[/-](\\d{1,2})[/-](\\d{2,4})', 2) AS m, regexp_extract(h, '(\\d{1,2})[/-](\\d{1,2})[/-](\\d{2,4})', 1) AS d
FROM (SELECT id, regexp_extract(text, '""" + _re2(pii.BIRTH) + """') AS h FROM samples))))""", "samples")
def birth_age(t):
    return t.samples.select("id", pii.age(pii.birth_date(F.col("text")), F.lit("2025-06-01").cast("date")).alias("age"))


SENT = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), '([.!?])\\s+([A-ZÁÉÍÓÚ])', '\\1' || chr(10) || '\\2', 'g'), chr(10)), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


@query(f"SELECT document_id, CAST(len(s) AS INTEGER) AS sentences, s[1] AS first_sentence FROM (SELECT document_id, {SENT} AS s FROM docs)", "docs")
def sentence_split(t):
    s = text.sentences(F.col("text"))
    return t.documents.select("document_id", F.size(s).alias("sentences"), F.try_element_at(s, F.lit(1)).alias("first_sentence"))


@query("SELECT chunk_id, CAST(greatest(1, length(content) // 3) AS INTEGER) AS chunk_tokens, CAST(floor(length(content) / 2.2) AS INTEGER) AS context_tokens FROM chunks", "chunks")
def token_estimate(t):
    c = F.col("content")
    return t.chunks.select("chunk_id", text.chunk_tokens(c).alias("chunk_tokens"), text.context_tokens(c).alias("context_tokens"))


FOLD_SQL = f""", pg AS (SELECT document_id, page, trim(string_agg(content, chr(10) ORDER BY chunk_index), chr(32) || chr(9) || chr(10) || chr(13)) AS text, max(edad) AS age FROM chunks GROUP BY document_id, page),
pi AS (SELECT *, greatest(1, length(text) // 3) AS k, row_number() OVER (PARTITION BY document_id ORDER BY page) AS i FROM pg WHERE text <> ''),
gr AS (SELECT document_id, i, k AS size, 0 AS grp, age FROM pi WHERE i = 1 UNION ALL
  SELECT p.document_id, p.i, CASE WHEN g.size + p.k > 1000 THEN p.k ELSE g.size + p.k END, CASE WHEN g.size + p.k > 1000 THEN g.grp + 1 ELSE g.grp END, coalesce(g.age, p.age) FROM gr g JOIN pi p ON p.document_id = g.document_id AND p.i = g.i + 1),
tx AS (SELECT document_id, grp, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, list(page ORDER BY i) AS pages, arg_max(g.age, i) AS age FROM gr g JOIN pi USING (document_id, i) GROUP BY document_id, grp),
se AS (SELECT document_id, grp, pages, age, {SENT} AS s FROM tx),
st AS (SELECT document_id, grp, pages, age, n, s[n] AS x, greatest(1, length(s[n]) // 3) AS k, n = len(s) AS final FROM (SELECT *, unnest(range(1, len(s) + 1)) AS n FROM se)),
fo AS (SELECT document_id, grp, n, [{{'x': x, 'k': k}}] AS held, k AS total, [pages[1]] AS seen, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS INTEGER[]) AS on_, CAST(NULL AS BIGINT) AS tokens FROM st WHERE n = 1 UNION ALL
  SELECT document_id, grp, n, list_append(rest, {{'x': x, 'k': k}}), coalesce(list_sum(list_transform(rest, lambda h: h.k)), 0) + k, list_append(CASE WHEN full_ THEN [] ELSE seen END, pages[least(n, len(pages))]),
    CASE WHEN full_ THEN array_to_string(list_transform(held, lambda h: h.x), ' ') END, CASE WHEN full_ THEN list_sort(list_distinct(seen)) END, CASE WHEN full_ THEN total END
  FROM (SELECT *, CASE WHEN full_ THEN held[1 + len(list_filter(range(1, len(held) + 1), lambda i: list_sum(list_transform(held[i:], lambda h: h.k)) > 50)):] ELSE held END AS rest
    FROM (SELECT s.document_id, s.grp, s.n, s.x, s.k, s.pages, f.held, f.total, f.seen, f.total + s.k > 500 AS full_ FROM fo f JOIN st s ON s.document_id = f.document_id AND s.grp = f.grp AND s.n = f.n + 1))),
al AS (SELECT document_id, grp, n, 0 AS last, content, on_, tokens FROM fo WHERE content IS NOT NULL UNION ALL
  SELECT f.document_id, f.grp, f.n, 1, array_to_string(list_transform(held, lambda h: h.x), ' '), list_sort(list_distinct(seen)), total FROM fo f JOIN st s ON s.document_id = f.document_id AND s.grp = f.grp AND s.n = f.n WHERE s.final)
SELECT al.document_id, CAST(row_number() OVER (PARTITION BY al.document_id ORDER BY al.grp, al.n, last) - 1 AS INTEGER) AS chunk_index, content, array_to_string(on_, ',') AS pages, CAST(tokens AS INTEGER) AS token_count, age AS edad FROM al JOIN tx USING (document_id, grp)"""


@query(FOLD_SQL, "chunks")
def chunk_fold(t):
    pages = t.chunks.groupBy("document_id", F.col("page_numbers")[0].alias("page")).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("l"), F.max("edad").alias("age"))
    joined = pages.select("document_id", "page", F.array_join(F.transform("l", lambda x: x["content"]), "\n").alias("text"), "age")
    return chunking.chunk_pages(joined).select("document_id", "chunk_index", "content", F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("pages"), "token_count", "edad")


@query(FOLD_SQL, "chunks")
def chunk_fold_function(t):
    """The chunks by the table function of SQL."""
    tables.register(t.spark)
    page, age = F.col("page_numbers")[0].alias("page"), F.max("edad").alias("age")
    grouped = t.chunks.groupBy("document_id", page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n").alias("text"), age)
    return t.spark.sql("SELECT document_id, chunk_index, content, array_join(transform(page_numbers, p -> CAST(p AS STRING)), ',') AS pages, token_count, edad FROM chunk_fold(TABLE({pages}))", pages=grouped)


TITLED = "(?m)" + fixed.HEADING


@query(f"""SELECT chunk_id, CASE WHEN length(body) <= 240 THEN body ELSE substring(body, 1, 237) || '...' END AS fragment,
CASE WHEN regexp_extract(body, '{TITLED}', 1) <> '' THEN trim(array_to_string(list_transform(string_split(lower(regexp_extract(body, '{TITLED}', 1)), ' '), lambda w: upper(w[1]) || w[2:]), ' ')) ELSE trim(substring(trim(string_split(body, chr(10))[1]), 1, 80)) END AS section
FROM (SELECT chunk_id, trim(CASE WHEN chunk_index % 2 = 0 THEN (chunk_index % 5) || '. ' || upper(regexp_replace(substring(content, 1, 40), '[^A-Za-z ]', '', 'g')) || chr(10) || content ELSE content END) AS body FROM chunks)""", "chunks")
def section_fragment(t):
    """Every other chunk opens with a heading made of its first words in capitals."""
    head = F.concat((F.col("chunk_index") % 5).cast("string"), F.lit(". "), F.upper(F.regexp_replace(F.substring("content", 1, 40), "[^A-Za-z ]", "")), F.lit("\n"), "content")
    body = F.trim(F.when(F.col("chunk_index") % 2 == 0, head).otherwise(F.col("content")))
    return t.chunks.select("chunk_id", text.excerpt(body).alias("fragment"), F.trim(text.heading(body)).alias("section"))


@query("""SELECT document_id, CASE WHEN document_id % 4 = 0 THEN 'Ana Lopez ' || document_id END AS nombre, CASE WHEN document_id % 150 <= 120 THEN CAST(document_id % 150 AS VARCHAR) END AS edad, ['F', 'F', 'M', NULL, 'M', 'M'][document_id % 6 + 1] AS sexo,
CASE document_id % 3 WHEN 0 THEN CASE WHEN length(document_id || '5678') BETWEEN 6 AND 12 THEN document_id || '5678' END WHEN 1 THEN NULL ELSE 'AB123456' END AS dni, CASE document_id % 4 WHEN 0 THEN 'HC-' || document_id WHEN 3 THEN 'A1B2' END AS historia_clinica,
CASE WHEN document_id % 4 <> 1 THEN strftime(make_date(2024, CAST(document_id % 12 + 1 AS INTEGER), CAST(document_id % 28 + 1 AS INTEGER)), '%d/%m/%Y') END AS fecha_atencion FROM docs""", "docs")
def patient_fields(t):
    n = F.col("document_id")
    pick = lambda m, *v: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v]), (n % m + 1).cast("int"))
    day, month = F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lpad((n % 12 + 1).cast("string"), 2, "0")
    number = n.cast("string")
    raw = {
        "nombre": pick(4, F.concat(F.lit(" Ana Lopez "), number, F.lit(" ")), "Paciente X", "##", F.lit(None).cast("string")),
        "edad": F.concat((n % 150).cast("string"), F.lit(" anios")),
        "sexo": pick(6, "Femenino", "mujer", "H", "?", "M.", "Masculino"),
        "dni": pick(3, F.concat(number, F.lit("-5678")), "12", "AB 123456"),
        "historia_clinica": pick(4, F.concat(F.lit("HC-"), number), "12345", "historia 1", "A1B2"),
        "fecha_atencion": pick(4, F.concat(day, F.lit("/"), month, F.lit("/2024")), "2024-02-30", F.concat(F.lit("2024-"), month, F.lit("-"), day), F.concat(day, F.lit("."), month, F.lit(".2024"))),
    }
    p = t.documents.select(n, *[v.alias(k) for k, v in raw.items()])
    check = {"nombre": fields.name, "edad": fields.age, "sexo": fields.sex, "dni": fields.national_id, "historia_clinica": fields.record_number, "fecha_atencion": fields.date}
    return p.select("document_id", *[f(F.col(c)).alias(c) for c, f in check.items()])


WORDS = "string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(trim({c}))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"
SMALL = ", ".join(f"'{w}'" for w in fixed.SMALL_TALK)
GREET = ", ".join(f"'{w}'" for w in fixed.GREETINGS)
TALK = "(VALUES (1, 'Hola, buenos días'), (2, 'gracias doctor'), (3, '¿Qué dosis toma el paciente?'), (4, 'quien eres'), (5, ''), (6, 'the license'), (7, 'hola necesito ver algo largo de veras hoy'))"


@query(f"SELECT id, CASE WHEN array_to_string(w, ' ') = '' THEN false ELSE NOT regexp_matches(array_to_string(w, ' '), '{fixed.CLINICAL}') AND ((len(w) <= 5 AND len(list_filter(w, lambda x: x NOT IN ({SMALL}))) = 0) OR (len(w) <= 6 AND len(list_filter(w, lambda x: x IN ({GREET}))) > 0)) END AS small FROM (SELECT id, {WORDS.format(c='text')} AS w FROM (SELECT * FROM {TALK} AS t(id, text) UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations))")
def smalltalk_flags(t):
    talk = t.spark.sql(f"SELECT * FROM {TALK[1:-1]} AS t(id, text)").select(F.col("id").cast("long").alias("id"), "text")
    turns = t.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return talk.union(turns).select("id", text.is_small_talk(F.col("text")).alias("small"))


@query("SELECT conversation_id, string_agg('(' || role || ') ' || substring(content, 1, 140), chr(10) ORDER BY turn) AS history FROM (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) <= 4) GROUP BY conversation_id", "messages")
def last_n_memory(t):
    from archivolt.operators import lifecycle

    return lifecycle.memory(t.messages)


PAGED = "(SELECT * FROM (VALUES (1, 1, [1, 2]), (2, 1, [1]), (3, 1, [3]), (4, 2, [1, 9]), (5, 4, [1]), (6, 9, [1])) AS t(chunk_id, document_id, pages))"


@query("SELECT chunk_id, min(score) AS ocr_score, arg_min(engine, score * 1000000 + page) AS ocr_engine, coalesce(min(score) < 45, false) AS low_confidence FROM (SELECT chunk_id, document_id, unnest([page, page + 1]) AS page FROM chunks) LEFT JOIN (SELECT * FROM ocr_pages WHERE score IS NOT NULL) USING (document_id, page) GROUP BY chunk_id", "ocr_pages")
def ocr_worst_page(t):
    page = F.col("page_numbers")[0]
    return ocr.worst_page(t.chunks.select("chunk_id", "document_id", F.array(page, page + 1).alias("page_numbers")), t.ocr_pages)


@query("SELECT document_id, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM ocr_pages WHERE score < 45 GROUP BY document_id", "ocr_pages")
def ocr_low_pages(t):
    return ocr.low_pages(t.ocr_pages)


@query("SELECT document_id, coalesce(avg(score) FILTER (WHERE score > 0), 0) AS mean FROM ocr_pages GROUP BY document_id", "ocr_pages")
def ocr_mean_confidence(t):
    return t.ocr_pages.groupBy("document_id").agg(ocr.mean_confidence("score").alias("mean"))


@query("""SELECT id, least(ax, bx) AS x, least(ay, by_) AS y, greatest(1, abs(bx - ax)) AS w, greatest(1, abs(by_ - ay)) AS h FROM (SELECT id,
CASE angle WHEN 90 THEN y WHEN 180 THEN page_w - x WHEN 270 THEN page_w - y ELSE x END AS ax, CASE angle WHEN 90 THEN page_h - x WHEN 180 THEN page_h - y WHEN 270 THEN x ELSE y END AS ay,
CASE angle WHEN 90 THEN y + h WHEN 180 THEN page_w - x - w WHEN 270 THEN page_w - y - h ELSE x + w END AS bx, CASE angle WHEN 90 THEN page_h - x - w WHEN 180 THEN page_h - y - h WHEN 270 THEN x + w ELSE y + h END AS by_ FROM boxes)""", "boxes")
def box_remap(t):
    m = ocr.remap({c: F.col(c) for c in "xywh"}, F.col("angle"), F.col("page_w"), F.col("page_h"))
    return t.boxes.select("id", *[v.alias(k) for k, v in m.items()])


@query("SELECT id, text FROM boxes WHERE contains(lower(text), 'licens')", "boxes")
def word_box_search(t):
    return ocr.find_words(t.boxes, "LICENS").select("id", "text")


@query(f"SELECT DISTINCT canonical, {NORM.format(c='canonical')} AS normal, replace({NORM.format(c='canonical')}, ' ', '') AS compact FROM edges", "edges")
def normalize_terms(t):
    c = F.col("canonical")
    return t.edges.select("canonical", text.normal_term(c).alias("normal"), text.compact_term(c).alias("compact")).distinct()


@query("SELECT document_id, ['admin', 'editor', 'assistant', 'auditor', 'assistant', 'viewer', 'assistant'][document_id % 7 + 1] AS role FROM docs", "docs")
def role_names(t):
    names = F.array(*map(F.lit, (" Administrador ", "especialista", "otro", "auditoría", None, "VIEWER", "asistente")))
    return t.documents.select("document_id", text.role(F.element_at(names, (F.col("document_id") % 7 + 1).cast("int"))).alias("role"))


@query("""SELECT document_id, CASE WHEN a <> '' AND s >= 60 THEN 'first' WHEN b IS NOT NULL AND (u >= s OR a = '') THEN 'second' ELSE 'first' END AS engine, u >= 60 AND u > 1.15 * s AS turned
FROM (SELECT document_id, CASE WHEN document_id % 5 = 0 THEN '' ELSE 'x' END AS a, CASE WHEN document_id % 7 <> 0 THEN 'y' END AS b, (document_id * 17) % 100 AS s, (document_id * 31) % 100 AS u FROM docs)""", "docs")
def ocr_cascade(t):
    n = F.col("document_id")
    s, u = ((n * 17) % 100).cast("double"), ((n * 31) % 100).cast("double")
    chosen = ocr.cascade(F.when(n % 5 == 0, "").otherwise("x"), s, F.when(n % 7 != 0, "y"), u)
    return t.documents.select("document_id", chosen.alias("engine"), ocr.rotate(s, u).alias("turned"))


@query("SELECT document_id, length(trim(text)) < 20 AS empty FROM docs", "docs")
def empty_pages(t):
    return t.documents.select("document_id", ocr.is_empty_page(F.col("text")).alias("empty"))


@query("SELECT document_id, regexp_matches(lower(text), '" + fixed.REFUSAL + "') AS refusal FROM docs", "docs")
def refusal_flags(t):
    return t.documents.select("document_id", text.is_refusal(F.col("text")).alias("refusal"))
