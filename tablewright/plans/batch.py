"""The whole plan: requests and documents in, guides and reports out, set by set.

Documents are parsed and described once, whatever the number of requests. Requests
walk from their page over at most HOPS links, equal questions as one; each hop is one round of joins over all
requests at once, and its tables are written to the shared folder, so that plans stay
small. Both attempts (the size system asked for, and the fallback) run side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.domain import FIELDS
from tablewright.functions import categories, navigation, sizes, urls
from tablewright.functions.text import slug, text_or_null
from tablewright.operators import candidates, export, links, markdown, matrix, outbox, redirects, select, validate, versions
from tablewright.sources import files
from tablewright.sources import html as pages
from tablewright.sources.requests import COLUMNS, chosen_documents, guard
from tablewright.sources.shared import written
from tablewright.sources.sinks import payload

HOPS = 2
DOC = ["doc_url", "renderer"]
KEY = ["request_id", "attempt"]
#: What of an attempt decides its answer; brand, name and issues of the request don't.
QUESTION = ["size_guide_url", "fallback_urls", "asked_category", "asked_system", "asked_audience"]
#: Issue of a request whose followed links gave no guide, and the errors behind it that its details name.
LED_NOWHERE, MOST_DETAILS = "no-valid-followed-guide", 8
STEP = "struct<kind:string,url:string,label:string,confidence:double,reasons:array<string>>"


@dataclass
class Corpus:
    """What is known of the documents before any request is seen."""

    facts: DataFrame
    tables: DataFrame
    links: DataFrame
    chosen: DataFrame
    failed: DataFrame


def read_corpus(documents: DataFrame, moment=None, steps: DataFrame | None = None) -> Corpus:
    """Parse documents (url, renderer, source_url, html, markdown) once.

    A document without markdown gets it from its html. Nulls count as empty. Of several
    versions of a document one is read (versions.one_version, at moment); one whose fetch
    failed isn't parsed. steps (url, to) are redirects: links of a page resolve against
    where its url ends, and a url without a document stands for the one it leads to.
    """
    names = ["url", "renderer", "source_url", "html", "markdown"]
    if steps is not None:
        documents = redirects.with_final_urls(documents, steps)
    docs = versions.one_version(documents, moment)
    failed = written(docs.where("failure IS NOT NULL").select("url", "renderer", "failure"), "failed")  # the reject channel of fetch and parser
    docs = docs.where("failure IS NULL").select(*names).withColumns({c: F.coalesce(c, F.lit("")) for c in ("html", "markdown")})
    docs = written(pages.with_markdown(docs), "documents")
    every = written(pages.parse(docs), "parsed")
    broken = every.where("error IS NOT NULL").select("url", "renderer", F.concat(F.lit("parse-error "), "error").alias("failure"))
    failed = failed.unionByName(broken)
    parsed = every.where("error IS NULL").drop("error").withColumnRenamed("url", "doc_url")
    docs = docs.join(broken.select("url", "renderer"), ["url", "renderer"], "left_anti")
    keyed = docs.select(F.col("url").alias("doc_url"), "renderer", F.coalesce("source_url", "url").alias("url"), "html", "markdown")
    lines = written(markdown.lines(keyed, DOC), "lines")

    facts = keyed.join(parsed.select(*DOC, "n_tables", "body"), DOC)
    text = F.substring(F.when(F.col("markdown") != "", F.col("markdown")).otherwise(F.col("body")), 1, 20000)
    blocks = lines.withColumn("_sep", markdown.is_separator(F.col("after")) & F.col("text").contains("|"))
    blocks = blocks.groupBy(*DOC).agg(F.count_if("_sep").alias("md_blocks"))
    head = F.concat_ws(" ", "markdown", F.substring("html", 1, 8000))
    facts = facts.join(blocks, DOC, "left").select(
        *DOC, "url",
        F.when(F.col("n_tables") > 0, F.col("n_tables")).otherwise(F.coalesce("md_blocks", F.lit(0))).alias("blocks"),
        navigation.table_signals(F.col("html"), F.col("markdown")).alias("signals"),
        navigation.category_signals(text).alias("kinds"), navigation.is_dead(head).alias("dead"),
        navigation.has_table_content(F.col("html"), F.col("markdown")).alias("has_table"),
    )

    order = {k: i for i, k in enumerate(("html-table", "aria-grid", "markdown-table", "markdown-grid", "div-grid", "advisory-text"))}
    from_html = parsed.select(*DOC, F.explode("tables").alias("t")).select(*DOC, "t.*")
    raw = from_html.unionByName(markdown.piped_tables(lines, DOC)).unionByName(markdown.loose_grids(lines, DOC))
    described = candidates.evidence(candidates.describe(raw))
    signals = F.size(F.filter(F.flatten("matrix"), lambda c: sizes.is_size(c) | F.exists(F.array(c), lambda x: x.rlike("(?i)chest|bust|waist|hip|inseam|height|sleeve|neck|taille|poitrine"))))
    described = described.withColumn("_n", signals).where((F.col("kind") != "div-grid") | (F.col("_n") >= 3)).drop("_n")
    place = Window.partitionBy(*DOC, "kind").orderBy("ord")
    described = described.withColumn("_rn", F.row_number().over(place)).where(f"kind <> 'div-grid' OR _rn <= {pages.GRIDS}")
    kind_no = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for k, i in order.items()])
    described = described.withColumn("ord", (kind_no.cast("long") * 10**9 + F.col("_rn"))).drop("_rn")
    tables = candidates.dedupe(described, DOC, candidates.SIGNATURE, "base_confidence")

    from_html = parsed.select(*DOC, F.explode("links").alias("l")).select(*DOC, "l.*").withColumn("ord", F.col("ord").cast("long"))
    from_md = markdown.links(lines, DOC).withColumn("ord", F.col("ord") + 10**16)
    found = from_html.unionByName(from_md).withColumn("resolver", F.lit("generic"))
    chosen = chosen_documents(docs).select("url", F.col("url").alias("doc_url"), "renderer")
    if steps is not None:
        ends = redirects.final_urls(steps).where("final_url IS NOT NULL").select(F.col("url").alias("from"), F.col("final_url").alias("end"))
        led = ends.join(chosen, F.col("end") == F.col("url")).select(F.col("from").alias("url"), "doc_url", "renderer")
        chosen = chosen.unionByName(led.join(chosen.select("url"), "url", "left_anti"))
    return Corpus(written(facts, "facts"), written(tables, "tables"), written(found, "raw-links"), written(chosen, "chosen"), failed)


def attempts(requests: DataFrame) -> DataFrame:
    """One row for each request and attempt, with what it asks for and its issues."""
    c, s, a = F.col("garment_category"), F.col("size_system"), F.col("audience")
    first = requests.withColumns({"attempt": F.lit(0), "asked_system": categories.asked_system(s)})
    spare = categories.asked_system(F.col("fallback_size_system"))
    second = requests.withColumns({"attempt": F.lit(1), "asked_system": spare})
    second = second.where(spare.isNotNull() & ~spare.eqNullSafe(categories.asked_system(s)))
    both = first.unionByName(second)
    system = F.when(F.col("attempt") == 0, s).otherwise(F.col("fallback_size_system"))
    step = F.struct(
        F.lit("requested-url").alias("kind"), F.col("size_guide_url").alias("url"), F.coalesce("name", "brand").alias("label"),
        F.lit(1.0).alias("confidence"), F.array(F.lit("requested")).alias("reasons"),
    )
    return both.withColumn("barred", guard(F.col("brand"), F.col("size_guide_url"))).select(
        *KEY, "barred", "brand", "name", "size_guide_url", "fallback_urls", "asked_system",
        categories.asked_category(c).alias("asked_category"), F.coalesce(categories.asked_audience(a), F.lit("men")).alias("asked_audience"),
        validate.request_issues(c, system, a).alias("request_issues"), F.array(step.cast(STEP)).alias("trace"),
    )


def questions(asked: DataFrame) -> DataFrame:
    """The frontier that the attempts begin with: one row for all attempts that ask the same of the same page.

    Requests of a popular page are many, what they ask is little: links are scored and
    candidates chosen once for each question, which stands in for a request until answered().
    """
    same = [F.first(c).alias(c) for c in (*QUESTION, "trace")]
    one = asked.where("barred IS NULL").groupBy("question").agg(*same).withColumnRenamed("question", "request_id")
    return one.withColumns({"attempt": F.lit(0), "doc_url": F.col("size_guide_url"), "navigation": F.lit(0.0), "link_followed": F.lit(False)})


def answered(found: DataFrame, of: DataFrame) -> DataFrame:
    """What was found for questions, for each attempt that asked them; of holds question, request, attempt and first step."""
    return found.join(of, F.col("request_id") == F.col("_q")).drop(*KEY, "_q").withColumnsRenamed({f"_{k}": k for k in KEY})


def look(frontier: DataFrame, corpus: Corpus, hop: int) -> tuple[DataFrame, DataFrame]:
    """Classify the frontier's documents: (frontier with kind and the link to follow, scored candidates)."""
    here = frontier.join(corpus.facts, DOC)
    raw = corpus.links.join(here.select(*KEY, *DOC, "url", "asked_category", "asked_system"), DOC)
    known = links.official(here, [*KEY, *DOC, "url", "asked_category", "asked_system"]).withColumn("ord", F.col("ord") + 2 * 10**16)
    scored = links.best_per_url(links.score(raw.unionByName(known.select(*raw.columns))), KEY)
    winner = links.clear_winner(links.follow(scored, KEY, F.lit(hop >= 1)), KEY, F.lit(True))
    chosen = written(links.logged(winner, KEY), "links")
    per_page = chosen.groupBy(*KEY).agg(
        F.count("*").alias("n_links"), F.max("link_score").alias("best_link"),
        F.max(F.when(F.col("followed"), F.struct("link_url", "label", "resolver", "hub_score", "link_reasons"))).alias("next"),
        F.array_sort(F.collect_list("logged")).alias("links"), F.bool_or("clear").alias("clear_link"),
    )
    kind = navigation.document_kind(
        F.coalesce("n_links", F.lit(0)), F.coalesce("best_link", F.lit(0.0)), F.col("blocks"), F.col("signals"), F.col("kinds"), F.col("dead")
    )
    gone = F.col("dead") & ~F.col("has_table")
    here = here.join(per_page, KEY, "left").withColumn("document_kind", F.when(gone, "irrelevant").otherwise(kind)).withColumn("gone", gone)
    here = written(here.withColumn("source_type", navigation.source_type(F.col("document_kind"), F.col("url"))), "looked")

    leaves = here.where("document_kind NOT IN ('guide-hub-page', 'irrelevant')")
    cands = corpus.tables.join(leaves.select(*KEY, *DOC, "url", "document_kind", "navigation", "link_followed", "asked_category", "asked_system", "asked_audience"), DOC)
    cands = cands.withColumn("confidence", candidates.confidence(F.col("base_confidence"), F.col("navigation")))
    return here, written(select.pick(select.score(cands), KEY, "new_ord"), "candidates")


def summary(here: DataFrame, cands: DataFrame) -> DataFrame:
    """here with the number of candidates, families and whether one is selected."""
    per = cands.groupBy(*KEY).agg(
        F.count("*").alias("n_candidates"), F.bool_or("selected").alias("has_selected"),
        F.array_sort(F.collect_set(F.when(F.col("tabular") & (F.col("family") != "unknown"), F.col("family")))).alias("families"),
        F.bool_and(F.exists("strict", lambda x: x == "size-system-not-compatible")).alias("all_system"),
        F.bool_or(F.exists("strict", lambda x: x == "category-not-tops")).alias("any_category"),
    )
    return here.join(per, KEY, "left").withColumns(
        {"n_candidates": F.coalesce("n_candidates", F.lit(0)), "has_selected": F.coalesce("has_selected", F.lit(False))}
    )


def walk(frontier: DataFrame, corpus: Corpus) -> tuple[list[DataFrame], list[DataFrame]]:
    """Follow the frontier over HOPS hops: final rows and candidates of every hop.

    A page that gave nothing is looked at once more as rendered, where its request
    led there by a link or named a guide directly.
    """
    done, found = [], []
    rendered = corpus.facts.where("renderer = 'rendered'").select("doc_url").distinct()
    lost_refetch = corpus.failed.where("renderer = 'rendered'").select(F.col("url").alias("doc_url"), F.col("failure").alias("refetch_failure"))
    for hop in range(HOPS + 1):
        rows, cands = [], []
        for turn in (0, 1):
            here, picked = look(frontier, corpus, hop)
            here = summary(here, picked)
            hub = F.col("document_kind") == "guide-hub-page"
            direct = urls.is_direct_guide(F.col("url"))
            concrete = urls.is_concrete_direct_guide(F.col("url"), F.col("asked_category"))
            stuck = F.when(hub, F.lit(hop >= HOPS) | F.col("next").isNull() | (F.lit(hop == 0) & concrete)).otherwise(~F.col("has_selected"))
            again = F.lit(turn == 0) & (F.col("renderer") != "rendered") & (F.lit(hop > 0) | direct) & stuck & ~F.col("gone")
            here = written(here.withColumn("_again", again), "walked")
            if turn == 0:
                here = here.join(lost_refetch, "doc_url", "left").withColumn("refetch_failure", F.when(F.col("_again"), F.col("refetch_failure")))
            retry = here.where("_again").join(rendered, "doc_url", "left_semi") if turn == 0 else here.limit(0)
            stay = here.join(retry.select(*KEY), KEY, "left_anti") if turn == 0 else here
            rows.append(stay)
            cands.append(picked.join(stay.select(*KEY), KEY, "left_semi"))
            if turn == 1 or retry.isEmpty():
                break
            frontier = retry.select(*frontier.columns).withColumn("renderer", F.lit("rendered"))
        level = written(_all(rows), "level")
        found.append(_all(cands))
        ahead = level.where((F.col("document_kind") == "guide-hub-page") & F.col("next").isNotNull()) if hop < HOPS else level.limit(0)
        done.append(level.join(ahead.select(*KEY), KEY, "left_anti").withColumn("hop", F.lit(hop)))
        if ahead.isEmpty():
            break
        frontier = _followed(ahead, frontier.columns, corpus)
        lost = ahead.join(frontier.select(*KEY), KEY, "left_anti")
        done.append(lost.withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
    return done, found


def _followed(ahead: DataFrame, names: list[str], corpus: Corpus) -> DataFrame:
    """The frontier behind the followed links; official fallbacks are read as rendered."""
    n = F.col("next")
    fallback = n["resolver"] == "brand-fallback"
    step = links.trace_step(lambda name: n[name]).cast(STEP)
    moved = ahead.withColumns(
        {
            "trace": F.array_append("trace", step), "navigation": navigation.follow_confidence(n["hub_score"]), "link_followed": F.lit(True),
            "doc_url": n["link_url"], "_as": F.when(fallback, "rendered"),
        }
    ).drop("renderer")
    chosen = corpus.chosen.toDF("doc_url", "_doc", "renderer")
    ready = corpus.facts.where("renderer = 'rendered'").select("doc_url", "renderer")
    own = moved.where("_as IS NULL").join(chosen, "doc_url").withColumn("doc_url", F.col("_doc")).drop("_doc")
    first = own.unionByName(moved.where("_as IS NOT NULL").join(ready, "doc_url"))
    return written(first.select(*names), "frontier")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def _rows(cands: DataFrame, external: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Validated candidates by extraction (table, then external rows), and their sizes."""
    key = [*KEY, "new_ord"]
    own = written(matrix.measured(cands, key), "sizes")
    rows = own.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("row_ord", "label", F.map_keys("raw").alias("fields")))).alias("rows"))
    none = F.array().cast("array<struct<row_ord:int,label:string,fields:array<string>>>")
    made = cands.join(rows, key, "left").withColumn("rows", F.coalesce("rows", none))
    made = made.withColumn("extraction_confidence", export.extraction_confidence(F.col("confidence"), F.size("rows")))
    return written(validate.validate(made).withColumn("strategy", export.strategy(F.col("kind"))), "validated"), own


def resolve(
    requests: DataFrame, documents: DataFrame, external: DataFrame | None = None, moment=None, steps: DataFrame | None = None,
    inbox: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(reports, sizes) of normalised requests against documents.

    A report holds status, issues (code, severity, details), document kind, hops,
    trace, the selected candidate's columns and attempt; has_guide says whether the
    result may be exported. sizes are the rows of the selected candidates. Requests that
    the guard bars are reported without being walked. external rows (request_id,
    row_ord, label, and optionally canonical, variant, warnings and <field>_low and
    <field>_high) of another extraction count where the table's own extraction isn't
    ready and no issue forbids it; then they are the sizes, too. Documents may come in
    versions (fetched_at, status, content_type; moment chooses) and with redirects (steps);
    see read_corpus(). A request whose page's fetch failed is a server-error that names
    why, and so is, as rendered-refetch-failed, a second look that had to fail. Of requests
    with the same request_id the first by all their columns counts. With an inbox (see
    operators/outbox.py) reports say what was asked of another extraction and how it
    answered, and its rows are the external ones; outbox.pending() of the reports is what is left to ask.
    """
    corpus = read_corpus(documents, moment, steps)
    names = [c for c in requests.columns if c in ("request_id", *COLUMNS)]
    requests = requests.groupBy("request_id").agg(F.min(F.struct(*[c for c in names if c != "request_id"])).alias("_r")).select("request_id", "_r.*")
    asked = attempts(requests).withColumn("question", F.sha2(F.to_json(F.struct(*QUESTION), {"ignoreNullFields": "false"}), 256))
    asked = written(asked, "attempts")
    chosen = corpus.chosen.toDF("doc_url", "_doc", "renderer")
    done, found = walk(questions(asked).join(chosen, "doc_url").withColumn("doc_url", F.col("_doc")).drop("_doc"), corpus)
    final, picked = _all(done), _all(found).where("selected")
    validated, own = _rows(picked, external)
    of = asked.where("barred IS NULL").select(F.col("question").alias("_q"), *[F.col(k).alias(f"_{k}") for k in KEY], F.get("trace", F.lit(0)).alias("_first"))
    final = answered(final, of).withColumn("trace", F.concat(F.array("_first"), F.slice("trace", F.lit(2), F.size("trace")))).drop("_first")
    validated, own = (answered(df, of).drop("_first") for df in (validated, own))
    told = None
    if inbox is not None:
        validated = written(validated, "validated")
        asks = outbox.asks(validated, KEY)
        first = asks.groupBy("request_id").agg(F.min("attempt").alias("attempt"))  # one answer a request
        answered_rows, told = outbox.answers(written(asks.join(first, KEY), "asks"), inbox, KEY)
        given = answered_rows.drop("attempt")
        external = given if external is None else external.unionByName(given, allowMissingColumns=True)
    if external is not None:
        other = external_sizes(external)
        validated = written(_with_external(validated, other), "validated")
        own = _sizes_with_external(own, validated, other)
    keep = ["new_ord", "title", "subheading", "evidence", "headers", "stub", "size_axis", "mapping", "rule", "rejections", "external_warnings", "orientation", "unit", "category", "family", "size_system", "audience", "confidence", "score", "present", "resolved_category", "resolved_system", "rows", "issues", "status", "extraction_confidence", "strategy"]
    if "external_warnings" not in validated.columns:
        validated = validated.withColumn("external_warnings", F.lit(None).cast("array<string>"))
    out = asked.select(*KEY, "barred", "brand", "name", "size_guide_url", "request_issues").join(
        final.drop("brand", "name", "size_guide_url", "request_issues", "fallback_urls"), KEY, "left"
    ).join(validated.select(*KEY, *[F.col(c) for c in keep]), KEY, "left")
    lost = corpus.failed.groupBy(F.col("url").alias("lost_url")).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "renderer", "failure"))).alias("lost"))
    out = out.join(lost, F.col("size_guide_url") == F.col("lost_url"), "left").drop("lost_url")
    if told is not None:
        out = out.join(told, KEY, "left")
    else:
        out = out.withColumn("external_outcome", F.lit(None).cast("string")).withColumn("external_message", F.lit(None).cast("string"))
    hub = F.col("document_kind") == "guide-hub-page"
    many = F.size(F.coalesce("families", F.array().cast("array<string>"))) > 1
    picked = F.coalesce("has_selected", F.lit(False))
    flow = validate.issues(
        validate.issue(F.col("doc_url").isNull(), "server-error", details=F.coalesce(F.when(F.col("barred").isNull(), F.col("lost")), F.array_compact(F.array("barred")))),
        validate.issue(F.col("refetch_failure").isNotNull() & ~picked, "rendered-refetch-failed", details=F.array_compact(F.array("refetch_failure"))),
        validate.issue(F.col("gone"), "page-not-found-document"),
        validate.issue(hub & F.col("next").isNull() & (F.col("hop") < HOPS), "no-followable-guide-link"),
        validate.issue(hub & (F.col("next").isNotNull() | (F.col("hop") >= HOPS)), "unresolved-guide-hub"),
        validate.issue((F.col("document_kind") == "irrelevant") & ~F.col("gone"), "irrelevant-document"),
        validate.issue(~hub & (F.col("document_kind") != "irrelevant") & (F.col("n_candidates") == 0), "no-candidates-discovered"),
        validate.issue(many & picked, "multiple-categories-detected", "warning", F.col("families")),
        validate.issue(many & ~picked, "multiple-categories-detected", details=F.col("families")),
        validate.issue(~many & ~picked & (F.col("n_candidates") > 0), "no-unique-section-match"),
        validate.issue(picked & (F.size("request_issues") > 0), "invalid-request"),
        validate.issue((F.col("hop") > 0) & ~picked, LED_NOWHERE),
        validate.issue(F.col("external_outcome") == "error", "llm-fallback-error", "warning", F.array_compact(F.array("external_message"))),
        validate.issue(F.size(F.coalesce("external_warnings", F.array().cast("array<string>"))) > 0, "llm-warning", "warning", F.col("external_warnings")),
    )
    none = F.array().cast(f"array<{validate.ISSUE}>")
    ready = validate.is_ready(F.col("status"), F.col("resolved_category"), F.col("resolved_system")) & (F.size("request_issues") == 0)
    behind = F.slice(validate.codes(F.filter(F.concat(flow, F.coalesce("issues", none)), lambda i: (i["severity"] == "error") & (i["code"] != LED_NOWHERE))), 1, MOST_DETAILS)
    flow = F.transform(flow, lambda i: F.when(i["code"] == LED_NOWHERE, i.withField("details", behind)).otherwise(i))
    out = out.withColumns({"has_guide": F.coalesce(ready, F.lit(False)), "all_issues": F.concat("request_issues", flow, F.coalesce("issues", none))})
    ambiguous = (many & ~picked) | (~many & ~picked & (F.col("n_candidates") > 0))
    status = F.when(F.col("has_guide"), "accepted").when(picked & (F.size("request_issues") == 0), F.col("status")).when(ambiguous, "ambiguous").otherwise("rejected")
    out = written(out.withColumn("report_status", status), "reports")
    return best_attempt(out), own


def external_sizes(external: DataFrame) -> DataFrame:
    """External rows in the form of own sizes: absent columns are null, and of a range's ends either stands for both.

    Rows without a label are left out.
    """
    have = set(external.columns)

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    ends = []
    for f in FIELDS:
        low, high = given(f"{f}_low", "double"), given(f"{f}_high", "double")
        ends += [F.coalesce(low, high).alias(f"{f}_low"), F.coalesce(high, low).alias(f"{f}_high")]
    label = F.trim("label")
    return external.select(
        "request_id", F.col("row_ord").cast("int").alias("row_ord"), label.alias("label"), *ends,
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("raw"),
        F.coalesce(given("canonical", "string"), sizes.canonical(label)).alias("canonical"),
        F.coalesce(given("variant", "string"), F.lit("unknown")).alias("variant"), given("warnings", "array<string>").alias("warnings"),
    ).where(F.col("label") != "")


def _with_external(validated: DataFrame, other: DataFrame) -> DataFrame:
    """validated with external rows where the own extraction isn't ready and they validate."""
    open_ = ~validate.is_ready(F.col("status"), F.col("resolved_category"), F.col("resolved_system")) & validate.may_extract_elsewhere(F.col("issues"))
    fields = F.array_compact(F.array(*[F.when(F.col(f"{f}_low").isNotNull(), F.lit(f)) for f in FIELDS]))
    rows = other.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("row_ord", "label", fields.alias("fields")))).alias("_rows"),
        F.array_distinct(F.flatten(F.collect_list("warnings"))).alias("external_warnings"),
    )
    made = ["present", "resolved_category", "resolved_system", "issues", "status"]
    tried = validated.where(open_).drop(*made).join(rows, "request_id").withColumn("rows", F.col("_rows")).drop("_rows")
    tried = validate.validate(tried).withColumns({"strategy": F.lit("external"), "extraction_confidence": export.external_confidence(F.size("rows"))})
    good = tried.where(validate.is_ready(F.col("status"), F.col("resolved_category"), F.col("resolved_system")))
    return validated.join(good.select(*KEY), KEY, "left_anti").unionByName(good, allowMissingColumns=True)


def _sizes_with_external(own: DataFrame, validated: DataFrame, other: DataFrame) -> DataFrame:
    """The sizes of tables, and those of external rows for the requests that these gave a guide."""
    taken = validated.where("strategy = 'external'").select(*KEY, "new_ord")
    return own.join(taken, [*KEY, "new_ord"], "left_anti").unionByName(other.drop("warnings").join(taken, "request_id").select(*own.columns))


def failed_on_system(reports: DataFrame) -> Column:
    """Whether a report failed for its size system and not for its category."""
    codes = validate.codes(F.col("all_issues"))
    system = F.arrays_overlap(codes, F.array(F.lit("size-system-mismatch"), F.lit("missing-size-system"))) | F.coalesce("all_system", F.lit(False))
    category = F.coalesce("any_category", F.lit(False)) | F.exists(
        "all_issues", lambda i: (i["code"] == "multiple-categories-detected") & (i["severity"] == "error")
    )
    return system & ~category


def best_attempt(reports: DataFrame) -> DataFrame:
    """One report for each request: the first attempt, or the fallback where only that
    gave a guide and the first failed for its size system; a warning tells of it."""
    first = Window.partitionBy("request_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = reports.withColumns({"_may": F.first(failed_on_system(reports) & ~F.col("has_guide")).over(first), "_n": F.max("attempt").over(first)})
    use = F.when(F.col("attempt") == 0, 1).when(F.col("has_guide") & F.col("_may"), 0)
    order = Window.partitionBy("request_id").orderBy(F.col("_use").asc_nulls_last())
    df = df.withColumn("_use", use).withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    told = validate.issues(
        validate.issue(F.col("attempt") == 1, "fallback-size-system-used", "warning"),
        validate.issue((F.col("attempt") == 0) & (F.col("_n") == 1) & F.col("_may"), "fallback-size-system-skipped", "warning"),
    )
    df = df.withColumn("all_issues", F.concat(told, "all_issues"))
    df = df.withColumn("summary", export.summary(
        F.col("has_guide"), F.col("title"), F.col("status"), F.coalesce(F.col("strategy") == "external", F.lit(False)),
        validate.codes(F.col("all_issues")), F.coalesce("rejections", F.array().cast("array<string>")),
    ))
    review = F.col("report_status") != "accepted"
    return df.withColumn("run_status", export.run_status(F.col("has_guide"), validate.codes(F.col("all_issues")), review)).drop("_may", "_n", "_use", "_rn")


def import_payloads(reports: DataFrame, sizes_: DataFrame) -> DataFrame:
    """One import payload for each request with a guide.

    brand and guide are structs as the import schema has them; a guide's rows hold their
    place (from 0), id, dimensions and notes, a guide's provenance what it was read
    from. warnings tell of a fallback of the size system, of a category that the schema
    lacks and of ignored fields.
    Ids are made of the request's, so that a rerun gives the same.
    """
    good = reports.where("has_guide")
    guide_id = F.concat_ws("-", F.lit("guide"), slug(F.col("brand")), slug(F.col("resolved_category")), slug(F.col("resolved_system")), F.substring("request_id", 1, 12))
    note = F.concat(F.lit("Read from "), F.col("source_url"))
    source = good.select(*KEY, "new_ord", F.col("url").alias("source_url"), F.concat(F.lit("sa-"), guide_id).alias("guide_id"))
    rows = export.import_rows(sizes_.join(source, [*KEY, "new_ord"]).withColumn("source_note", note), "source_note")
    per = rows.groupBy(*KEY).agg(
        F.collect_list(F.struct("row_ord", "guide_id", "canonical", "label", "variant", "dimensions", "notes", "ignored")).alias("_r")
    )
    ordered = F.array_sort("_r", lambda a, b: F.when(a["row_ord"] < b["row_ord"], -1).when(a["row_ord"] > b["row_ord"], 1).otherwise(0))
    size_rows = F.transform(
        F.col("_r"),
        lambda r, i: F.struct(
            F.concat(r["guide_id"], F.lit("-row-"), (i + 1).cast("string")).alias("id"), r["guide_id"].alias("guide_id"),
            F.when(r["canonical"] != "", r["canonical"]).otherwise(r["label"]).alias("label"), i.alias("sort_order"),
            r["dimensions"].alias("dimensions"), r["notes"].alias("notes"), r["ignored"].alias("ignored"),
        ),
    )
    c, s = F.col("resolved_category"), F.col("resolved_system")
    ignored = F.array_distinct(F.flatten(F.transform("size_rows", lambda r: r["ignored"])))
    told = F.filter("all_issues", lambda i: i["code"].isin("fallback-size-system-used", "fallback-size-system-skipped"))
    warnings = validate.issues(
        validate.issue(F.size(ignored) > 0, "shopping-assistant-dimensions-ignored", "warning", ignored),
        validate.issue(export.falls_back(c), "shopping-assistant-category-fallback", "warning", F.array(c)),
    )
    complete = export.is_complete(F.transform("size_rows", lambda r: r["dimensions"]))
    brand = F.struct(
        F.concat(F.lit("brand-"), slug(F.col("brand"))).alias("id"), F.col("brand").alias("name"), urls.origin(F.col("size_guide_url")).alias("website")
    )
    guide = F.struct(
        F.concat(F.lit("sa-"), guide_id).alias("id"), F.concat(F.lit("brand-"), slug(F.col("brand"))).alias("brand_id"),
        F.coalesce(text_or_null(F.col("name")), F.concat("brand", F.lit(" – "), c, F.lit(" ("), s, F.lit(")"))).alias("name"),
        export.export_category(c).alias("category"), export.export_system(s).alias("size_system"), F.lit("low").alias("fabric_stretch"),
        F.concat_ws(
            " ", F.concat(F.lit("Section: "), F.col("title"), F.lit(".")), F.concat(F.lit("Audience: "), F.col("audience"), F.lit(".")),
            F.concat(F.lit("Status: "), F.col("status"), F.lit(".")),
        ).alias("fit_notes"),
        F.lit("json_import").alias("source_type"), F.col("url").alias("source_url"), complete.alias("is_complete"),
        export.uncertainty(F.col("extraction_confidence")).alias("uncertainty"), F.col("size_rows").alias("rows"),
    )
    provenance = F.struct(
        F.col("size_guide_url").alias("requested_url"), "title", "audience", "source_type", "document_kind", "trace", "unit", "extraction_confidence",
        "status", "orientation", "mapping", "rule", "headers", "stub", "size_axis", "evidence", F.col("present").alias("fields"), "strategy",
        F.transform("_r", lambda r: r["label"]).alias("labels"), F.array_distinct(F.transform("_r", lambda r: r["variant"])).alias("variants"),
    )
    return good.join(per, KEY).withColumn("_r", ordered).withColumn("size_rows", size_rows).select(
        "request_id", "brand", export.export_category(c).alias("category"), export.export_system(s).alias("size_system"),
        complete.alias("is_complete"), export.uncertainty(F.col("extraction_confidence")).alias("uncertainty"),
        export.file_name(F.col("brand"), c, s).alias("file"), export.strict_error(c, s).alias("strict_error"), "size_rows",
        F.struct(brand.alias("brand"), guide.alias("guide")).alias("payload"), provenance.alias("provenance"), F.concat(told, warnings).alias("warnings"),
    )


def strict_guides(reports: DataFrame, sizes_: DataFrame) -> DataFrame:
    """The narrow export of each request with a guide: sizes (label, chest_cm, waist_cm), or why it has none."""
    good = reports.where("has_guide")
    c, s = F.col("resolved_category"), F.col("resolved_system")
    rows = export.strict_rows(sizes_.join(good.select(*KEY, "new_ord"), [*KEY, "new_ord"]))
    per = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("row_ord", "strict"))).alias("_r"))
    error = export.strict_error(c, s)
    return good.join(per, KEY).select(
        "request_id", "brand", F.col("url").alias("source_url"), error.alias("error"),
        F.when(error.isNull(), F.transform("_r", lambda r: r["strict"])).alias("sizes"),
        F.when(error.isNull(), export.strict_confidence(F.col("extraction_confidence"))).alias("confidence"),
    )


def previews(reports: DataFrame, sizes_: DataFrame) -> DataFrame:
    """The sizes of every guide as a reader is shown them: request_id, row_ord, label and shown (field, text)."""
    good = reports.where("has_guide").select(*KEY, "new_ord")
    return export.shown_rows(sizes_.join(good, [*KEY, "new_ord"])).select("request_id", "row_ord", "label", "shown")


def export_files(reports: DataFrame, sizes_: DataFrame, pretty: bool = False) -> DataFrame:
    """export_kind, file and json of both exports of every guide, for sinks.write_exports() and write_guides()."""
    payloads = import_payloads(reports, sizes_)
    wide = payloads.select(F.lit("shopping-assistant").alias("export_kind"), "file", payload(pretty, brand=F.col("payload.brand"), guide=F.col("payload.guide")).alias("json"))
    strict = strict_guides(reports, sizes_).join(payloads.select("request_id", "file"), "request_id")
    return wide.unionByName(
        strict.select(F.lit("strict").alias("export_kind"), "file", payload(pretty, brand=F.col("brand"), source_url=F.col("source_url"), error=F.col("error"), sizes=F.col("sizes"), confidence=F.col("confidence")).alias("json"))
    )


def write_guides(reports: DataFrame, sizes_: DataFrame, path: str, form: str = "files") -> None:
    """A pretty file for each guide and export below path, or with form zip archives of both folders (files.write_files)."""
    made = export_files(reports, sizes_, pretty=True)
    files.write_files(made.select(F.col("export_kind").alias("folder"), "file", F.col("json").alias("text")), path, form)
