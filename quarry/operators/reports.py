"""Case runs, diagnoses, audits, handouts, grounds, cards and dossiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import cards
from quarry.functions.text import cache_form, match_form, truncate
from quarry.operators.matching import first_wins
from quarry.operators.retrieval import rank_by
from quarry.operators.rules import readiness

#: Longest handout, longest part of one, and most parts.
HANDOUT, PART, PARTS = 36_000, 6_000, 6
#: Longest excerpt of a norm in a card.
EXCERPT = 400

# What an audit asks for.
AUDIT_TABLES = (
    "dispositivos", "enquadramentos", "configuracoes", "cache_respostas", "ip_bloqueados", "uso_diario", "documentos", "documento_trechos",
)
AUDIT_FUNCTIONS = ("rag_schema_version", "search_dispositivos_tsvector", "search_dispositivos_vector")
RAG_SCHEMA_VERSION, QUALITY_SCHEMA_VERSION, FOREIGN_SCHEMA_VERSION = 10, 11, 13


def case_positions(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, pos, ms, passed): place of the first expected result (A10).

    cases(case_id, expected array, exact, max_pos), results(case_id, found array, ms): a result counts as expected if it
    equals one, or starts with one where exact is false, in lower case and single spaces. A case without results fails.
    """
    joined = cases.join(results, "case_id", "left")
    wanted = F.transform("expected", cache_form)
    hit = F.transform("found", lambda v: F.exists(wanted, lambda e: F.when(F.col("exact"), cache_form(v) == e).otherwise(F.startswith(cache_form(v), e))))
    pos = F.nullif(F.array_position(hit, F.lit(True)), F.lit(0))
    passed = F.coalesce(pos <= F.col("max_pos"), F.lit(False))
    return joined.select("case_id", pos.alias("pos"), F.coalesce("ms", F.lit(0)).alias("ms"), passed.alias("passed"))


def case_metrics(positions: DataFrame) -> DataFrame:
    """One row total, hit1, hit3, mean_ms, worst_ms of case_positions(): shares in per cent with two digits (A10)."""
    n = F.count("*")

    def share(test: Column) -> Column:
        return F.coalesce(F.round(100.0 * F.count_if(test) / F.nullif(n, F.lit(0)), 2), F.lit(0.0))

    return positions.agg(
        n.alias("total"), share(F.col("pos") == 1).alias("hit1"), share(F.col("pos") <= 3).alias("hit3"),
        F.coalesce(F.round(F.avg("ms"), 2), F.lit(0.0)).alias("mean_ms"), F.coalesce(F.max("ms"), F.lit(0)).alias("worst_ms"),
    )


def case_problems(cases: DataFrame, categories: list[str]) -> DataFrame:
    """(case_id, problem) of cases(case_id, category, expected, max_pos): empty when the set is good."""
    wrong = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("case_id"), F.lit("")) == "", "no id"),
            F.when(~F.coalesce(F.col("category").isin(categories), F.lit(False)), "category"),
            F.when(F.coalesce(F.size("expected"), F.lit(0)) < 1, "nothing expected").when(F.exists("expected", lambda x: x == ""), "empty expected"),
            F.when(~F.coalesce(F.col("max_pos").isin(1, 3), F.lit(False)), "place"),
        )
    )
    twice = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("duplicate").alias("problem"))
    return cases.select("case_id", F.explode(wrong).alias("problem")).unionByName(twice)


def manifest_problems(manifest: DataFrame, required: list[str]) -> DataFrame:
    """(collection, problem) of manifest(collection, valid_from, checked_on, state): repeated, missing or ill-formed."""
    date = r"^\d{4}-\d{2}-\d{2}$"
    wrong = F.array_compact(
        F.array(
            F.when(~F.col("valid_from").rlike(date), "valid_from"), F.when(~F.col("checked_on").rlike(date), "checked_on"),
            F.when(~F.coalesce(F.col("state").isin("vigente", "revisar", "substituido"), F.lit(False)), "state"),
        )
    )
    twice = manifest.groupBy("collection").count().where("count > 1").select("collection", F.lit("duplicate").alias("problem"))
    need = manifest.sparkSession.createDataFrame([(c,) for c in required], "collection string")
    absent = need.join(manifest, "collection", "left_anti").select("collection", F.lit("missing").alias("problem"))
    return manifest.select("collection", F.explode(wrong).alias("problem")).unionByName(twice).unionByName(absent)


def diagnosis(stats: DataFrame, local: DataFrame, runs: DataFrame, vectors: Column) -> DataFrame:
    """One row per collection: counts of documents and local items, vector cover, case results and verdict.

    stats(collection, documents, chunks, without_vector, empty, short, duplicates), local(collection, items, invalid,
    duplicates), runs(collection, hit1, hit3). vectors: whether a collection has vectors at all. A collection may lack any.
    """
    l_ = local.select("collection", "items", F.col("invalid").alias("bad"), F.col("duplicates").alias("twice"))
    joined = stats.join(l_, "collection", "full_outer").join(runs, "collection", "left")
    zero = joined.na.fill(0)
    chunks = F.col("chunks") + F.col("items")
    cover = F.when(vectors & (chunks > 0), F.round(100.0 * (chunks - F.col("without_vector")) / chunks, 2))
    made = zero.select(
        "collection", "documents", chunks.alias("chunks"), "without_vector", cover.alias("vector_cover"),
        (F.col("empty") + F.col("short") + F.col("bad")).alias("invalid"), (F.col("duplicates") + F.col("twice")).alias("duplicates"), "hit1", "hit3",
    )
    verdict = readiness(F.col("invalid"), F.col("duplicates"), F.col("chunks"), F.col("hit1"), F.col("hit3"))
    return made.withColumn("status", verdict)


def audit_checks(facts: DataFrame) -> DataFrame:
    """(id, status, detail) of one row of facts about a catalogue.

    facts: vector, unaccent, tables, row_security and functions (maps of names to booleans), private_open (boolean),
    privileged_open (boolean), rag_schema_version, bucket_exists, bucket_public, seed_examples (array).
    """

    def lacking(have: str, names: tuple[str, ...]) -> Column:
        want = F.array(*map(F.lit, names))
        return F.array_join(F.filter(want, lambda n: ~F.coalesce(F.try_element_at(have, n), F.lit(False))), ", ")

    def check(name: str, good: Column, detail: Column | str = "") -> Column:
        status = F.when(F.coalesce(good, F.lit(False)), "ok").otherwise("bloqueio")
        return F.struct(F.lit(name).alias("id"), status.alias("status"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))

    tables, rules, functions = lacking("tables", AUDIT_TABLES), lacking("row_security", AUDIT_TABLES), lacking("functions", AUDIT_FUNCTIONS)
    seeds = F.struct(F.lit("seed_examples").alias("id"), F.lit("atencao").alias("status"), F.array_join("seed_examples", ", ").alias("detail"))
    checks = F.array(
        check("extensions", F.col("vector") & F.col("unaccent")),
        check("tables", tables == "", tables),
        check("rls", rules == "", rules),
        check("private_tables", ~F.col("private_open")),
        check("search_functions", functions == "", functions),
        check("privileged_functions", ~F.col("privileged_open")),
        check("rag_schema_version", F.col("rag_schema_version") == RAG_SCHEMA_VERSION, F.col("rag_schema_version").cast("string")),
        check("bucket", F.col("bucket_exists") & ~F.col("bucket_public")),
        F.when(F.size("seed_examples") > 0, seeds),
    )
    return facts.select(F.explode(F.array_compact(checks)).alias("c")).select("c.*")


def audit_status(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The worst status of all checks: bloqueio over atencao over ok."""
    rank = F.when(F.col("status") == "bloqueio", 2).when(F.col("status") == "atencao", 1).otherwise(0)
    worst = F.coalesce(F.max(rank), F.lit(0))
    return checks.groupBy(*(by or [])).agg(F.element_at(F.array(F.lit("ok"), F.lit("atencao"), F.lit("bloqueio")), worst + 1).alias("status"))


def cut_text(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` letters, cut at the last break unless that is in the first half."""
    out, rest = [], text.strip()
    while len(rest) > limit:
        brk = max(rest.rfind("\n", 0, limit + 1), rest.rfind(" ", 0, limit + 1))
        at = brk if brk >= limit // 2 else limit
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [*out, rest] if rest else out


def handout_parts(excerpts: DataFrame, by: str) -> DataFrame:
    """(by, part, text, pages, sections, problem): ordered excerpts as parts of at most 6,000 letters.

    excerpts(by, page, ord, section, text). Over 36,000 letters or six parts in all make one row with a problem instead,
    so a group that goes to the parts' function is bounded: longer ones are told by their length before.
    """
    texts = excerpts.where(F.length(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))) > 0).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    size = texts.groupBy(by).agg(F.sum(F.length("text")).alias("n"))
    long = size.where(F.col("n") > HANDOUT).select(by)
    kind = dict(excerpts.dtypes)[by]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = group[by].iloc[0]
        rows = group.assign(_p=group["page"].fillna(float("inf"))).sort_values(["_p", "ord"])
        parts: list[dict] = []
        for page, section, text in zip(rows["page"], rows["section"], rows["text"]):
            for piece in cut_text(text, PART):
                if not parts or len(parts[-1]["text"]) + 2 + len(piece) > PART:
                    parts.append({by: key, "part": len(parts), "text": piece, "pages": set(), "sections": {}})
                else:
                    parts[-1]["text"] += "\n\n" + piece
                if page == page and page is not None:
                    parts[-1]["pages"].add(int(page))
                if section:
                    parts[-1]["sections"][section] = None
        if len(parts) > PARTS:
            parts = [{by: key, "part": None, "text": None, "pages": (), "sections": (), "problem": "too long"}]
        out = [{"problem": None, **p, "pages": sorted(p["pages"]), "sections": list(p["sections"])} for p in parts]
        return pd.DataFrame(out, columns=[by, "part", "text", "pages", "sections", "problem"]).astype({"part": "Int64"})

    schema = f"`{by}` {kind}, part bigint, text string, pages array<bigint>, sections array<string>, problem string"
    fit = texts.join(long, by, "left_anti").select(by, F.col("page").cast("double").alias("page"), F.col("ord"), "section", "text")
    made = fit.groupBy(by).applyInPandas(run, schema)
    none = F.array()
    return made.unionByName(
        long.select(by, F.lit(None).cast("bigint").alias("part"), F.lit(None).cast("string").alias("text"), none.cast("array<bigint>").alias("pages"),
                    none.cast("array<string>").alias("sections"), F.lit("too long").alias("problem"))
    )


def joined_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, text): the pages of a document in order, each after its marker."""
    marked = F.concat(F.lit("[[página "), F.col(page).cast("string"), F.lit("]]\n"), F.coalesce(text, F.lit("")))
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), marked.alias("t")))).alias("l"))
    return rows.select(doc, F.array_join(F.col("l.t"), "\n\n").alias("text"))


def official_text(parts: list[tuple[str, Column]]) -> Column:
    """Labelled lines of an official text; arrays become lists under their label."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit(""))) for label, value in parts])


def styled_lines(text: Column) -> Column:
    """array<struct<text, style>> of a chapter: subtitles, items and paragraphs, marks removed."""

    def plain(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(x, r"^#{1,6}\s+", ""), r"\*\*([^*]+)\*\*", "$1")

    def style(x: Column) -> Column:
        head = x.rlike(r"^#{1,6}\s") | x.rlike(r"^\*\*[^*]+\*\*:?$")
        dot = x.rlike(r"^[-*•]\s")
        item = x.rlike(r"^(\d+[.)]|[a-d]\))\s")
        shown = F.when(head, F.regexp_replace(plain(x), ":$", "")).when(dot, F.concat(F.lit("• "), plain(F.regexp_replace(x, r"^[-*•]\s", "")))).otherwise(plain(x))
        return F.struct(shown.alias("text"), F.when(head, "subtitle").when(dot | item, "item").otherwise("paragraph").alias("style"))

    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, style)


def clean_criterion(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*\d+\s*[.)-]\s*", ""), r"\s+", " "))


def grounds(sheets: DataFrame, evidence: DataFrame, pending: DataFrame) -> DataFrame:
    """(code, confirmed, to_confirm, divergent, ready): what the answers say of a sheet, nothing inferred.

    sheets(code, to_fine array, not_to_fine array), evidence(code, place, criterion, source, answer, effect, told),
    pending(code, place, criterion, source). A scene that is confirmed settles the other scenes.
    """
    def ordered(value: Column, test: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("place", value.alias("v"))))), lambda x: x["v"])

    told = F.trim("told")
    e = evidence.groupBy("code").agg(
        F.max((F.col("source") == "quando_autuar") & (F.col("answer") == "sim")).alias("scene"),
        ordered(told, (F.col("effect") == "favoravel") & (told != "")).alias("confirmed"),
        ordered(F.struct(told.alias("told"), ((F.col("source") == "quando_autuar") & (F.col("answer") == "nao")).alias("other")), (F.col("effect") == "contraria") & (told != "")).alias("against"),
        F.collect_set(F.when(F.col("source") == "quando_nao_autuar", match_form("criterion"))).alias("answered"),
    )
    p = pending.groupBy("code").agg(
        ordered(F.col("criterion"), F.col("source") == "quando_autuar").alias("scenes"),
        ordered(F.col("criterion"), F.col("source") == "quando_nao_autuar").alias("exclusions"),
    )
    none = F.array().cast("array<string>")
    j = sheets.join(e, "code", "left").join(p, "code", "left")
    scene = F.coalesce("scene", F.lit(False))
    asks = F.transform(F.coalesce("scenes", none), lambda x: F.concat(F.lit("Confirme se: "), clean_criterion(x)))
    ask_sheet = F.array(F.lit("Confirme na ficha qual cenário de “Quando autuar” corresponde ao fato observado."))
    open_scene = F.when(scene, none).when(F.size(asks) > 0, asks).when(F.size(F.coalesce("to_fine", none)) > 0, ask_sheet).otherwise(none)
    every = F.filter(F.transform(F.concat(F.coalesce("not_to_fine", none), F.coalesce("exclusions", none)), clean_criterion), lambda x: x != "")
    keys = F.transform(every, lambda x: match_form(clean_criterion(x)))
    once = F.filter(every, lambda x, i: F.array_position(keys, match_form(x)) == i + 1)
    unanswered = F.filter(once, lambda x: ~F.array_contains(F.coalesce("answered", none), match_form(x)))
    to_confirm = F.concat(open_scene, F.transform(unanswered, lambda x: F.concat(F.lit("Confirme se a hipótese de não autuar ocorre: "), x)))
    against = F.filter("against", lambda x: ~(scene & x["other"]))
    divergent = F.coalesce(F.transform(against, lambda x: x["told"]), none)
    made = j.select("code", scene.alias("_s"), F.coalesce("confirmed", none).alias("confirmed"), to_confirm.alias("to_confirm"), divergent.alias("divergent"))
    ready = F.col("_s") & (F.size("to_confirm") == 0) & (F.size("divergent") == 0)
    return made.withColumn("ready", ready).drop("_s")


def infraction_cards(questions: DataFrame, infractions: DataFrame, norms: DataFrame) -> DataFrame:
    """One card per question(qid, text, code): the infraction of the code, its parts and the retrieved norms (C17).

    infractions(code, wording, severity, points, cents, unit, held, towed, document, support), norms(qid, place, label,
    text). A code that is unknown makes an empty card.
    """
    excerpt = F.struct("place", F.col("label"), truncate(F.col("text"), EXCERPT).alias("excerpt"), F.lit(True).alias("checked"))
    cited = norms.groupBy("qid").agg(F.array_sort(F.collect_list(excerpt)).alias("norms"))
    i = infractions.withColumn("found", F.lit(True))
    j = questions.join(i, "code", "left").join(cited, "qid", "left")
    own = F.struct(F.lit(1 << 30).alias("place"), F.col("support").alias("label"), F.lit(cards.NO_TEXT).alias("excerpt"), F.lit(False).alias("checked"))
    has = F.exists("norms", lambda n: F.contains(F.lower("support"), F.lower(n["label"])))
    cites = F.when(F.col("found") & ~F.coalesce(has, F.lit(False)), F.concat(F.coalesce("norms", F.array().cast("array<struct<place:int,label:string,excerpt:string,checked:boolean>>")), F.array(own))).otherwise(F.col("norms"))
    return j.select(
        "qid", F.lit("codigo").alias("kind"), F.coalesce("found", F.lit(False)).alias("success"), F.col("text").alias("question"), "code", "wording",
        F.when(F.col("found"), cards.checklist(F.col("held"), F.col("towed"), F.col("document"), F.col("support"))).alias("checklist"),
        F.when(F.col("found"), cards.mistakes(F.col("towed"), F.col("document"), F.col("cents"))).alias("mistakes"),
        F.when(F.col("found"), cards.is_crime(F.col("support"))).alias("crime"),
        F.when(F.col("found"), cards.licence(F.concat_ws(" ", "wording", "support"))).alias("licence"),
        cards.summary(*[F.col(c) for c in ("wording", "support", "severity", "points", "cents", "unit", "held", "towed", "document")]).alias("summary"),
        cards.example(F.col("wording"), F.col("support"), F.col("towed"), F.col("document")).alias("example"), cites.alias("citations"),
    )


def dossier(themes: DataFrame, infractions: DataFrame, norms: DataFrame, rulings: DataFrame, k_norms: int = 12, k_rulings: int = 10) -> DataFrame:
    """(theme, kind, n, id, text): the data of a thematic dossier.

    themes(theme, prefixes array, keywords array), infractions as for infraction_cards(), norms(theme, place, label,
    text) as found by keyword, rulings(id, subject). Codes by prefix, norms once by label, rulings by keyword, distinct
    checks, and three examples. The themes are the small side of both theta joins and go out in full.
    """
    t = F.broadcast(themes)  # a registry of themes, a few dozen rows
    codes = infractions.join(t, F.exists("prefixes", lambda p: F.startswith("code", p)))
    ranked = rank_by(codes, "theme", F.col("code"))
    parts = [ranked.select("theme", F.lit("code").alias("kind"), F.col("rank").alias("n"), F.col("code").alias("id"), F.col("wording").alias("text"))]
    once = rank_by(first_wins(norms, ["theme", "label"], F.col("place")), "theme", F.col("place"), F.col("label"), k=k_norms)
    parts.append(once.select("theme", F.lit("norm").alias("kind"), F.col("rank").alias("n"), F.col("label").alias("id"), "text"))
    near = rulings.join(t, F.exists("keywords", lambda w: F.contains(F.lower("subject"), F.lower(w))))
    near = rank_by(near, "theme", F.col("id"), k=k_rulings)
    parts.append(near.select("theme", F.lit("ruling").alias("kind"), F.col("rank").alias("n"), "id", F.col("subject").alias("text")))
    checks = ranked.select("theme", "rank", F.posexplode(cards.checklist(F.col("held"), F.col("towed"), F.col("document"), F.col("support"))).alias("i", "text"))
    checks = rank_by(first_wins(checks, ["theme", "text"], F.col("rank"), F.col("i")).withColumnRenamed("rank", "place"), "theme", F.col("place"), F.col("i"))
    parts.append(checks.select("theme", F.lit("check").alias("kind"), F.col("rank").alias("n"), F.lit("").alias("id"), "text"))
    scenes = ranked.where("rank <= 3")
    scene = cards.example(F.col("wording"), F.col("support"), F.col("towed"), F.col("document"))
    parts.append(scenes.select("theme", F.lit("example").alias("kind"), F.col("rank").alias("n"), F.col("code").alias("id"), scene.alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def review(examples: DataFrame, corrections: DataFrame) -> DataFrame:
    """examples(id, ..., expected, note, reviewed, reviewed_at) with corrections(id, expected, note, at) put in."""
    new = corrections.select("id", F.col("expected").alias("_e"), F.nullif(F.trim("note"), F.lit("")).alias("_n"), F.col("at").alias("_a"), F.lit(True).alias("_r"))
    hit = F.coalesce("_r", F.lit(False))
    j = examples.join(new, "id", "left")
    put = {c: F.when(hit, F.col(s)).otherwise(F.col(c)) for c, s in (("expected", "_e"), ("note", "_n"), ("reviewed", "_r"), ("reviewed_at", "_a"))}
    return j.withColumns(put).select(*examples.columns)


def to_review(examples: DataFrame, limit: int = 100) -> DataFrame:
    """Examples that nobody has reviewed first, then the newest, 1 to 500 of them."""
    return examples.orderBy(F.col("reviewed").asc(), F.col("created_at").desc(), "id").limit(clamped(limit, 1, 100, 500))


def clamped(n: int | None, low: int, default: int, high: int) -> int:
    """A limit between low and high, the default where none is given."""
    return max(low, min(default if n is None else n, high))


def in_batches(rows: DataFrame, text: str, send, most: int = 32, letters: int = 30_000) -> DataFrame:
    """(batch, rows, letters, problem) of rows handed to send(list of dicts) in batches of at most 32 rows and 30,000
    letters; a longer row is a batch of its own (S20).

    Batches are cut within partitions. send() runs on the executors; what it raises marks its batch and nothing else. A
    task that is run again sends its batches again, so send() must put rows by key.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        size, number = 0, 0

        def flush() -> pd.DataFrame:
            nonlocal held, size, number
            problem = None
            try:
                send(held)
            except Exception as e:  # a failed batch is a result of its own
                problem = f"{type(e).__name__}: {e}"[:200]
            out = pd.DataFrame({"batch": [number], "rows": [len(held)], "letters": [size], "problem": [problem]})
            held, size, number = [], 0, number + 1
            return out

        for frame in frames:
            for row in frame.to_dict("records"):
                n = len(row[text] or "")
                if held and (len(held) >= most or size + n > letters):
                    yield flush()
                held.append(row)
                size += n
        if held:
            yield flush()

    return rows.mapInPandas(run, "batch bigint, rows bigint, letters bigint, problem string")
