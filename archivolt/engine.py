"""The engine as one object: tables in, the application's operations as methods.

Methods return frames; those that change a table return its new version and
leave writing to the caller (see sources.sinks).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import schemas
from archivolt.functions import fixed, pii, text
from archivolt.models import ExtractiveGenerator, Generator, OverlapReranker, Reranker, rerank_logits
from archivolt.operators import chat, knowledge, lifecycle, ocr, retrieval, scorecard, workflow
from archivolt.sources import sinks


@dataclass
class User:
    user_id: int
    username: str
    role: str

    def may(self, permission: str) -> bool:
        return permission in fixed.PERMISSIONS.get(self.role, ())


@dataclass
class Engine:
    spark: SparkSession
    tables: dict[str, DataFrame]
    reranker: Reranker = field(default_factory=OverlapReranker)
    generator: Generator = field(default_factory=ExtractiveGenerator)
    profile: str = "full"

    def require(self, user: User | None, permission: str) -> None:
        """No user means that access control is off."""
        if user and not user.may(permission):
            raise PermissionError(permission)

    def _chunks(self, user: User | None) -> DataFrame:
        c = self.tables["chunks"]
        return c if user is None else retrieval.visible(c, self.tables["acl"], user.role)

    def search(self, queries: DataFrame, user: User | None = None, page: int | None = None, age: tuple[int | None, int | None] | None = None, domain: str | None = None, document_id: int | None = None, k: int = 30) -> DataFrame:
        """Hybrid search with filters applied before the cut; queries have query_id, query_text, query_vector."""
        self.require(user, "search")
        c = self._chunks(user)
        if document_id is not None:
            c = c.where(F.col("document_id") == document_id)
        if page is not None:
            c = retrieval.on_page(c, page)
        if age is not None:
            c = retrieval.in_age_range(c, *age)
        if domain is not None:
            c = retrieval.in_domain(c, self.tables["chunk_keywords"], self.tables["keywords"], domain)
        expanded = retrieval.expand_query(queries, self.tables["synonyms"]).drop("query_text").withColumnRenamed("expanded", "query_text")
        return retrieval.hybrid(c, expanded, k)

    @property
    def pools(self) -> tuple[int, int]:
        """Hits that are re-ranked and hits that stay, by profile."""
        return (5, 5) if self.profile == "fast" else (15, 10)

    def _supported(self, queries: DataFrame, user: User | None, candidates: int | None, k: int | None, **filters) -> tuple[DataFrame, DataFrame]:
        """Re-ranked hits with their chunks' columns, and those of them with enough evidence, ranked anew."""
        pool, keep = self.pools
        hits = self.search(queries, user, k=candidates or pool, **filters).join(queries.select("query_id", F.col("query_text").alias("_asked")), "query_id")
        scored = retrieval.rerank(hits.withColumn("_logit", rerank_logits("_asked", "content", self.reranker)), "_logit", k or keep)
        scored = scored.withColumn("evidence", F.coalesce("rerank_score", F.col("score") * 10))
        chunks = self.tables["chunks"]
        section = F.col("section") if "section" in chunks.columns else text.heading(F.col("content"))
        names = self.tables["documents"].select("document_id", F.col("original_name").alias("document_name"))
        full = scored.join(chunks.select("chunk_id", "document_id", "page_numbers", "edad", section.alias("section")), "chunk_id").join(names, "document_id", "left")
        full = full.persist()  # a few hits for each question, read by the context, the lines and the trace
        return full, retrieval.ranked_again(retrieval.evidence(full.drop("evidence")))

    def ask(self, queries: DataFrame, user: User | None = None, candidates: int | None = None, k: int | None = None) -> list[dict]:
        """An answer per question, or an abstention; contexts of the few hits left come to the driver.

        An answer that does not cite its sources is asked for once more; if it
        still does not, the first sources' lines follow it. Each question leaves
        a row in the audit table, if the engine has one.
        """
        self.require(user, "query")
        scored, kept = self._supported(queries, user, candidates, k)
        n = kept.groupBy("query_id").agg(F.count("*").alias("n"))
        rows = queries.select("query_id", "query_text").join(retrieval.pack_context(kept), "query_id", "left").join(n, "query_id", "left").join(chat.source_lines(kept), "query_id", "left").collect()
        answers = [self._answer(r.query_id, r.query_text, r.context, r.n or 0, r.lines) for r in rows]
        self._log(queries, scored, kept, answers, user)
        scored.unpersist()
        return [{c: v for c, v in x.items() if c != "raw"} for x in answers]

    def _answer(self, query_id: int, question: str, context: str | None, sources: int, lines: str | None = None) -> dict:
        if sources < retrieval.MIN_SOURCES:
            return {"query_id": query_id, "abstained": True, "answer": fixed.NO_EVIDENCE, "sources": 0, "grounded": False, "raw": None}
        answer, retried = self.generator.answer(question, context or ""), False
        if not self._grounded(answer, sources):
            answer, retried = self.generator.answer(question, (context or "") + fixed.CITE_AGAIN), True
        frame = self.spark.createDataFrame([(answer, lines)], "a string, l string")
        shown, grounded, refused = frame.select(chat.finished(F.col("a"), F.lit(sources), F.col("l")), text.is_grounded(F.col("a"), F.lit(sources)), text.is_refusal(F.col("a"))).first()
        return {"query_id": query_id, "abstained": False, "answer": shown, "grounded": grounded, "retried": retried, "sources": 0 if refused else sources, "raw": answer}

    def _grounded(self, answer: str, sources: int) -> bool:
        return self.spark.range(1).select(text.is_grounded(F.lit(answer), F.lit(sources))).first()[0]

    def _log(self, queries: DataFrame, scored: DataFrame, kept: DataFrame, answers: list[dict], user: User | None) -> None:
        if "audit" not in self.tables:
            return
        given = self.spark.createDataFrame([(a["query_id"], a["raw"]) for a in answers], "query_id bigint, answer string")
        rows = chat.trace(queries.select("query_id", "query_text"), scored, kept, given, retrieval.MIN_EVIDENCE)
        stamped = rows.drop("query_id").withColumns({"username": F.lit(user.username if user else None), "created_at": F.current_timestamp()})
        kept_rows = self.spark.createDataFrame(stamped.collect(), stamped.schema)  # one row a question, fixed now
        self.tables["audit"] = self.tables["audit"].unionByName(lifecycle.append_audit(kept_rows), allowMissingColumns=True)

    def open_conversation(self, user: User, name: str | None = None) -> int:
        self.require(user, "chat:write")
        new = self.spark.createDataFrame([(user.user_id, name)], "user_id bigint, title string").withColumn("created_at", F.current_timestamp())
        after = chat.opened(self.tables["conversations"], new)
        number = after.agg(F.max("conversation_id")).first()[0]
        self.tables["conversations"] = after
        return number

    def conversations(self, user: User) -> DataFrame:
        self.require(user, "chat:write")
        return chat.of_user(self.tables["conversations"], user.user_id)

    def delete_conversation(self, user: User, conversation_id: int) -> None:
        self.require(user, "chat:write")
        self.tables = chat.without(self.tables, user.user_id, conversation_id)

    def say(self, user: User, conversation_id: int, message: DataFrame, **filters) -> dict:
        """Answer one message (query_id, query_text, query_vector) of a user's own conversation, and keep both turns.

        Greetings are answered from the memory of the last turns alone, other
        messages from the documents, behind the memory. Without evidence the
        answer is a polite refusal.
        """
        self.require(user, "chat:write")
        own = self.tables["conversations"].where((F.col("conversation_id") == conversation_id) & (F.col("user_id") == user.user_id))
        if own.limit(1).count() == 0:
            raise LookupError(f"no conversation {conversation_id}")
        question = (message.first()["query_text"] or "").strip()
        if not question:
            raise ValueError("empty message")
        turns = self.tables["messages"].where(F.col("conversation_id") == conversation_id)
        last = chat.history(turns).first()
        history = last["history"] if last else ""
        if self.spark.range(1).select(text.is_small_talk(F.lit(question))).first()[0]:
            answer, sources = self.generator.answer(question, history), 0
        else:
            scored, kept = self._supported(message, user, None, self.pools[0], **filters)
            sources = kept.count()
            if sources < retrieval.MIN_SOURCES:
                answer, sources = fixed.NO_EVIDENCE_CHAT, 0
            else:
                context = retrieval.pack_context(kept).first()["context"]
                asked = self.spark.range(1).select(chat.prompt(F.lit(context), F.lit(history))).first()[0]
                answer = self.generator.answer(question, asked)
            scored.unpersist()
        shown, refused = self.spark.range(1).select(pii.mask(F.lit(answer)), text.is_refusal(F.lit(answer))).first()
        turn = (turns.agg(F.max("turn")).first()[0] or 0) + 1
        said = self.spark.createDataFrame([(conversation_id, turn, "user", question), (conversation_id, turn + 1, "assistant", shown)], "conversation_id bigint, turn bigint, role string, content string")
        self.tables["messages"] = self.tables["messages"].unionByName(said, allowMissingColumns=True)
        if turn == 1:
            first = F.col("conversation_id") == conversation_id
            self.tables["conversations"] = self.tables["conversations"].withColumn("title", F.when(first, chat.title(F.lit(question))).otherwise(F.col("title")))
        return {"conversation_id": conversation_id, "turn": turn + 1, "answer": shown, "sources": 0 if refused else sources}

    def give_feedback(self, user: User, conversation_id: int, turn: int, value: str) -> None:
        self.require(user, "chat:write")
        self.tables["messages"] = lifecycle.give_feedback(self.tables["messages"], self.tables["conversations"], user.user_id, conversation_id, turn, value)

    def keyword_list(self, user: User | None = None, category: str | None = None, inactive: bool = False) -> DataFrame:
        self.require(user, "keywords:read")
        return workflow.catalogue(self.tables["keywords"], category, inactive)

    def add_keyword(self, user: User | None, term: str, category: str | None = None) -> None:
        self.require(user, "keywords:write")
        self.tables["keywords"] = lifecycle.upsert_keyword(self.tables["keywords"], term, category)

    def drop_keyword(self, user: User | None, keyword_id: int) -> None:
        self.require(user, "keywords:write")
        self.tables["keywords"] = lifecycle.delete_keyword(self.tables["keywords"], keyword_id)

    def find_keyword(self, user: User | None, term: str) -> DataFrame:
        self.require(user, "search")
        t = self.tables
        return knowledge.search_keyword(term, t["keywords"], t["chunk_keywords"], t["chunks"], t["documents"])

    def candidates(self, user: User | None = None, status: str = "proposed") -> DataFrame:
        self.require(user, "keywords:read")
        return workflow.candidates(self.tables["keyword_candidates"], status)

    def approve_candidates(self, user: User | None, terms: list[str]) -> None:
        self.require(user, "keywords:write")
        chosen = self.spark.createDataFrame([(t,) for t in terms], "term string")
        self.tables["keyword_candidates"], self.tables["keywords"] = workflow.approve(self.tables["keyword_candidates"], self.tables["keywords"], chosen)

    def reject_candidates(self, user: User | None, terms: list[str]) -> None:
        self.require(user, "keywords:write")
        self.tables["keyword_candidates"] = workflow.reject(self.tables["keyword_candidates"], self.spark.createDataFrame([(t,) for t in terms], "term string"))

    def synonyms(self) -> DataFrame:
        return retrieval.synonym_groups(self.tables["synonyms"])

    def set_synonyms(self, user: User | None, canonical: str, variants: list[str], category: str | None = None) -> None:
        self.require(user, "keywords:write")
        self.tables["synonyms"] = lifecycle.replace_synonyms(self.tables["synonyms"], canonical, variants, category)

    def propose(self, user: User, chunk_id: int, content: str) -> None:
        self.require(user, "documents:read")
        if user.role not in workflow.MAY_PROPOSE:
            raise PermissionError("propose")
        if not content.strip():
            raise ValueError("empty content")
        new = self.spark.createDataFrame([(chunk_id, user.user_id, user.role, content)], "chunk_id bigint, proposer bigint, role string, content string")
        self.tables["proposals"] = workflow.propose(self.tables["proposals"], new)

    def review(self, user: User, chunk_id: int, status: str, comment: str | None = None) -> None:
        self.require(user, "documents:update")
        self.tables["proposals"] = lifecycle.review(self.tables["proposals"], chunk_id, status, user.user_id, comment)

    def add_plan(self, user: User | None, plan: dict) -> None:
        self.require(user, "admin:panel")
        new = self.spark.createDataFrame([plan], schemas.schema("action_plans"))
        self.tables["action_plans"] = workflow.add_plans(self.tables["action_plans"], new, scorecard.kpi_catalogue(self.spark))

    def plans(self, user: User | None = None) -> DataFrame:
        self.require(user, "bsc:read")
        return workflow.plans(self.tables["action_plans"])

    def patch_plan(self, user: User | None, plan_id: int, status: str | None = None, description: str | None = None) -> None:
        self.require(user, "admin:panel")
        patch = self.spark.createDataFrame([(plan_id, status, description)], "plan_id bigint, status string, description string")
        self.tables["action_plans"] = workflow.patch_plans(self.tables["action_plans"], patch)

    def usage(self, user: User | None = None) -> DataFrame:
        self.require(user, "bsc:read")
        return scorecard.usage(self.tables["audit"])

    def users(self, user: User | None = None) -> DataFrame:
        self.require(user, "users:read")
        return self.tables["users"].orderBy("created_at", "user_id")

    def add_user(self, user: User | None, username: str, email: str, role: str) -> str:
        """Add an account and return its role: the first one of all is an admin whatever is asked, later ones never are."""
        users = self.tables["users"]
        first = users.limit(1).count() == 0
        if not first:
            self.require(user, "users:create")
            if role not in fixed.ROLES or role == "admin":
                raise ValueError(role)
            if users.where(F.col("username") == username).limit(1).count():
                raise ValueError(f"user exists: {username}")
        given = "admin" if first else role
        number = users.agg(F.coalesce(F.max("user_id"), F.lit(0)) + 1).first()[0]
        new = self.spark.createDataFrame([(number, username, email, given, True)], "user_id bigint, username string, email string, role string, is_active boolean")
        self.tables["users"] = users.unionByName(new.withColumn("created_at", F.current_timestamp()), allowMissingColumns=True)
        return given

    def patch_user(self, user: User | None, user_id: int, role: str | None = None, is_active: bool | None = None) -> None:
        self.require(user, "users:update")
        changes = {c: v for c, v in {"role": role, "is_active": is_active}.items() if v is not None}
        if not changes:
            raise ValueError("nothing to change")
        hit = F.col("user_id") == user_id
        self.tables["users"] = self.tables["users"].withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})

    def delete_user(self, user: User, user_id: int) -> None:
        self.require(user, "users:update")
        self.tables = lifecycle.delete_user(self.tables, user_id, user.user_id)

    def upload(self, user: User | None, files: DataFrame) -> DataFrame:
        """What becomes of each file (file_id, filename, content): its hash and status, without exceptions."""
        self.require(user, "documents:upload")
        known = self.tables["documents"]
        return lifecycle.validate_files(files, known if "file_hash" in known.columns else None)

    def reprocess(self, user: User | None, ids: list[int]) -> None:
        self.require(user, "documents:update")
        again = F.col("document_id").isin(ids) & (F.col("status") != "processing")
        self.tables["documents"] = self.tables["documents"].withColumn("status", F.when(again, "pending").otherwise(F.col("status")))

    def document(self, document_id: int) -> DataFrame:
        return self.tables["documents"].where(F.col("document_id") == document_id)

    def patch_patient(self, user: User | None, patch: DataFrame) -> None:
        self.require(user, "documents:update")
        self.tables["patients"] = lifecycle.patch_patient(self.tables["patients"], patch)

    def correct_word(self, user: User | None, document_id: int, page: int, box_index: int, new: str) -> str:
        """Correct a recognised word in its box and, once, in each chunk of the page; returns the old word."""
        self.require(user, "documents:update")
        if not new.strip():
            raise ValueError("empty text")
        boxes = self.tables["word_boxes"]
        row = boxes.where((F.col("document_id") == document_id) & (F.col("page") == page) & (F.col("box_index") == box_index)).first()
        if row is None:
            raise LookupError("no such word")
        self.tables["word_boxes"] = ocr.correct_box(boxes, document_id, page, box_index, new)
        if row["text"] and row["text"] != new.strip():
            self.tables["chunks"] = lifecycle.correct_word(self.tables["chunks"], document_id, page, row["text"], new.strip())
        return row["text"]

    def history(self, user: User | None, n: int = 100) -> DataFrame:
        """The newest questions of the audit log, for an export."""
        self.require(user, "export")
        return self.tables["audit"].where("action = 'query'").orderBy(F.desc("created_at")).limit(n)

    def audit_export(self, user: User | None, n: int = 5000, since: str | None = None, until: str | None = None, **equal) -> DataFrame:
        self.require(user, "audit:read")
        rows = self.tables["audit"]
        for c, v in equal.items():
            rows = rows.where(F.col(c) == v)
        if since:
            rows = rows.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
        if until:
            rows = rows.where(F.col("created_at") <= F.lit(until).cast("timestamp"))
        return rows.orderBy(F.desc("created_at")).limit(n)

    def keyword_domains(self, user: User | None = None) -> DataFrame:
        self.require(user, "keywords:read")
        return knowledge.catalogue_domains(self.tables["keywords"])

    def patch_keyword(self, user: User | None, keyword_id: int, **changes) -> None:
        self.require(user, "keywords:write")
        self.tables["keywords"] = lifecycle.patch_keyword(self.tables["keywords"], keyword_id, **changes)

    def import_keywords(self, user: User | None, rows: DataFrame) -> int:
        """Add an import's new terms (term, category); returns how many there were."""
        self.require(user, "keywords:write")
        new = [tuple(r) for r in lifecycle.import_keywords(self.tables["keywords"], rows).select("term", "category").orderBy("term").collect()]
        k = self.tables["keywords"]
        start = k.agg(F.coalesce(F.max("keyword_id"), F.lit(0))).first()[0]
        added = self.spark.createDataFrame([(start + n, *r, 1, True) for n, r in enumerate(new, 1)], "keyword_id int, term string, category string, priority int, is_active boolean")
        self.tables["keywords"] = k.unionByName(added, allowMissingColumns=True)
        return len(new)

    def expand_term(self, term: str) -> list[str]:
        """All forms of the synonym groups that hold a term."""
        row = retrieval.expand_term(self.spark.createDataFrame([(term,)], "term string"), self.tables["synonyms"]).first()
        return list(row["forms"]) if row else []

    def drop_synonyms(self, user: User | None, canonical: str) -> None:
        self.require(user, "keywords:write")
        self.tables["synonyms"] = self.tables["synonyms"].where(F.col("canonical") != canonical)

    def import_synonyms(self, user: User | None, rows: DataFrame) -> int:
        """Add an import's new pairs (canonical, synonym, category); returns how many there were."""
        self.require(user, "keywords:write")
        s = self.tables["synonyms"]
        new = [tuple(r) for r in lifecycle.import_synonyms(s, rows).select("canonical", "synonym", "category").orderBy("canonical", "synonym").collect()]
        start = s.agg(F.coalesce(F.max("edge_id"), F.lit(0))).first()[0]
        self.tables["synonyms"] = s.unionByName(self.spark.createDataFrame([(start + n, *r) for n, r in enumerate(new, 1)], "edge_id int, canonical string, synonym string, category string"))
        return len(new)

    def knowledge(self, user: User | None = None, domain: str | None = None) -> dict[str, DataFrame]:
        """What the corpus knows of the catalogue: coverage, matches, gaps and heatmap."""
        self.require(user, "bsc:read")
        t = self.tables
        return {
            "coverage": knowledge.coverage(t["keywords"], t["chunk_keywords"]), "matches": knowledge.match_counts(t["keywords"], t["chunk_keywords"]),
            "gaps": knowledge.gaps_by_domain(t["keywords"], t["chunk_keywords"]), "heatmap": knowledge.heatmap(t["keywords"], t["chunk_keywords"], t["chunks"], t["documents"], domain),
        }

    def support(self, user: User | None = None, n: int = 50) -> dict:
        """The support index of the newest questions: their sources on average, with a middling score."""
        self.require(user, "bsc:read")
        last = self.tables["audit"].where("action = 'query'").orderBy(F.desc("created_at")).limit(n)
        seen, evidence = last.agg(F.count("*"), F.coalesce(F.round(F.avg(F.coalesce("n_sources", F.lit(0))), 2), F.lit(0.0))).first()
        index = scorecard.support(F.lit(evidence), F.lit(0), F.lit(0.5), F.lit(1 if seen else 0))
        value, level = self.spark.range(1).select(index, scorecard.support_level(index)).first()
        return {"index": value, "level": level, "queries": seen}

    def report(self, user: User | None = None, workbook: bool = False) -> bytes:
        """The scorecard with gaps and plans, as a PDF or an XLSX file."""
        self.require(user, "bsc:read")
        states, gaps, plans = self.scorecard(user), self.gaps(), self.tables["action_plans"]
        if workbook:
            return sinks.workbook({"kpis": states, "gaps": gaps, "plans": plans})
        lines = [r["line"] for r in sinks.report_rows(states, gaps, plans).orderBy("part", "key").collect()]
        return sinks.pdf("Scorecard", lines)

    def stream(self, answer: dict) -> Iterator[str]:
        """Events of an answer: sources, words, end."""
        yield f"sources {answer['sources']}"
        yield from (answer["answer"] or "").split()
        yield "[DONE]"

    def chunks_of(self, document_id: int) -> DataFrame:
        domains = knowledge.chunk_domains(self.tables["keywords"], self.tables["chunk_keywords"])
        return self.tables["chunks"].where(F.col("document_id") == document_id).join(domains, "chunk_id", "left").orderBy("chunk_index")

    def documents(self, page: int = 1, size: int = 20, status: str | None = None, name: str | None = None) -> DataFrame:
        d = self.tables["documents"]
        if status:
            d = d.where(F.col("status") == status)
        if name:
            d = d.where(F.col("original_name").ilike(f"%{name}%"))
        return lifecycle.page_of(d, page, size, F.desc("document_id"))

    def delete_documents(self, ids: list[int], user: User | None = None) -> None:
        self.require(user, "documents:delete")
        gone = self.spark.createDataFrame([(i,) for i in ids], "document_id long")
        self.tables = lifecycle.delete_documents(self.tables, gone)

    def audit_log(self, user: User | None, page: int = 1, size: int = 100, **equal) -> DataFrame:
        self.require(user, "audit:read")
        rows = self.tables["audit"]
        for c, v in equal.items():
            rows = rows.where(F.col(c) == v)
        return lifecycle.page_of(rows, page, size, F.desc("created_at"), F.desc("audit_id"))

    def scorecard(self, user: User | None = None) -> DataFrame:
        self.require(user, "bsc:read")
        return scorecard.with_state(scorecard.kpi_values(self.spark, self.tables))

    def score(self, weights: dict[str, float] | None = None) -> DataFrame:
        return scorecard.score(scorecard.kpi_values(self.spark, self.tables), weights)

    def gaps(self) -> DataFrame:
        return knowledge.gaps(self.tables["keywords"], self.tables["chunk_keywords"])


def register_functions(spark: SparkSession) -> None:
    """SQL functions that Catalyst inlines: norm_term, mask_pii, trgm_similarity, cosine_sim, kpi_state and kpi_norm."""

    def define(head: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    raw = lambda pattern: "r\"" + pattern + "\""
    plain = f"lower(translate(coalesce(s, ''), '{text.ACCENTED}', '{text.PLAIN}'))"
    define("norm_term(s STRING) RETURNS STRING", f"trim(regexp_replace(regexp_replace({plain}, {raw('(?U)[^' + chr(92) + 'w' + chr(92) + 's]|_')}, ' '), {raw(chr(92) + 's+')}, ' '))")
    masked = "s"
    for _, pattern, label in fixed.PII:
        masked = f"regexp_replace({masked}, {raw('(?U)' + pattern)}, '{label}')"
    define("mask_pii(s STRING) RETURNS STRING", masked)
    grams = "array_distinct(flatten(transform(filter(split(lower({c}), {p}), w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"
    x, y = (grams.format(c=c, p=raw("(?U)" + chr(92) + "W+")) for c in "ab")
    shared = f"size(array_intersect({x}, {y}))"
    define("trgm_similarity(a STRING, b STRING) RETURNS DOUBLE", f"coalesce(try_divide({shared}, size(array_union({x}, {y}))), 0D)")
    define("cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))")
    define("kpi_state(v DOUBLE, d STRING, a DOUBLE, r DOUBLE) RETURNS STRING", "CASE WHEN v IS NULL OR a IS NULL OR r IS NULL THEN 'gray' WHEN d = 'gte' THEN CASE WHEN v >= a THEN 'green' WHEN v >= r THEN 'amber' ELSE 'red' END ELSE CASE WHEN v <= r THEN 'green' WHEN v <= a THEN 'amber' ELSE 'red' END END")
    top = "CASE WHEN d = 'gte' THEN coalesce(a, t) ELSE a END"
    define("kpi_norm(v DOUBLE, d STRING, a DOUBLE, r DOUBLE, t DOUBLE) RETURNS DOUBLE", f"CASE WHEN v IS NULL THEN NULL ELSE greatest(0D, least(100D, CASE WHEN {top} IS NULL OR r IS NULL OR {top} = r THEN v WHEN d = 'gte' THEN (v - r) * 100 / ({top} - r) ELSE (r - v) * 100 / (r - {top}) END)) END")
