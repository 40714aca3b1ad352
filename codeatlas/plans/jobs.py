"""Composite jobs: the stages users run, each a composition of the library's operators.

Every job takes and returns DataFrames (writing is left to the caller or to ``sources.sinks``);
none collects rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keys import is_test_path
from ..operators.context import (attach_docs, attach_element_type, attach_instance, distinct_knowledge, docs_for_file,
                                 file_description, first_doc_wins, match_paths, prune_context)
from ..operators.elements import code_elements, drop_overlaps, elements_of, parsed_files, rejected_files
from ..operators.fences import fenced_elements, ranked_files
from ..operators.graph import (callables, callee_refs, doc_waves, element_calls, graph_nodes, import_edges, internal_imports,
                               reference_context)
from ..operators.incremental import pending, ready_inputs
from ..operators.media import instance_image_tokens
from ..operators.packing import PROMPT_BUDGET, pack_batches
from ..operators.retrieval import attach_vectors, chunk_recursive, retrieved_files, topk_similar, with_text_hash
from ..operators.sampling import SIMILARITY_THRESHOLD, keyframe_counts, keyframes
from ..operators.snapshots import carry_forward, content_runs, snapshot_diff, to_regenerate
from ..session import ensure_checkpoint_dir, shuffled

# Our own wording; callers fill in theirs where a model needs another.
DOC_PROMPT = "Document the %s `%s` of %s.\n\n%s\n\nIt uses:\n%s"
ELEMENT_PROMPT = "Issue:\n%s\n\nWhich of these elements are at fault?\n\n%s"
REPAIR_PROMPT = "Issue:\n%s\n\nMend this file.\n\n%s"
KEY = ["instance_key", "rel_path"]
INST = ["instance_key"]


def build_code_catalog(files: DataFrame) -> DataFrame:
    """C1: source files -> element table with overlapping nested functions removed; each file is parsed once."""
    ensure_checkpoint_dir(files.sparkSession)
    return drop_overlaps(code_elements(files, KEY).checkpoint(), KEY)


def catalog_and_quarantine(files: DataFrame, overlaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """C1 with its quarantine: ``(elements, rejected files with the reason)``, each file parsed once.
    ``overlaps`` keeps nested functions that overlap a kept one."""
    ensure_checkpoint_dir(files.sparkSession)
    parsed = parsed_files(files, KEY).checkpoint()
    elements = elements_of(parsed, KEY)
    return elements if overlaps else drop_overlaps(elements, KEY), rejected_files(parsed, KEY)


def build_import_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C2: ``(nodes, edges)`` of the import graph of each snapshot."""
    edges = import_edges(files, KEY)
    return graph_nodes(files, edges, INST), edges


def build_doc_meta(files: DataFrame, elements: DataFrame, edges: DataFrame,
                   element_cap: int = X.ELEMENT_TOKEN_CAP) -> DataFrame:
    """C3: per top-level element its type and the callees it references through internal imports (a
    method's calls are its class's).  Vendored bundles are left out; elements over the token cap stay,
    flagged ``over_cap`` and without callees."""
    el = elements.filter(F.col("node_key").isNotNull()
                         & ~F.col("rel_path").contains("mermaid.min.js") & ~F.col("rel_path").contains("video.min.js"))
    el = el.withColumn("over_cap", ~X.within_budget(X.token_count("content"), element_cap, strict=False))
    internal = internal_imports(edges, files, INST)
    refs = callee_refs(element_calls(el.filter(~F.col("over_cap")), KEY), internal, callables(elements, KEY), INST)
    typed = el.withColumn("type", F.when(F.col("kind") == "class", "Class").otherwise("Function"))
    return typed.join(refs.withColumnRenamed("src_path", "rel_path"), [*KEY, "start_line", "name"], "left")


def refresh_docs(old_docs: DataFrame, old_files: DataFrame, new_files: DataFrame, new_elements: DataFrame,
                 refs: DataFrame, new_key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C4: ``(carried docs, elements to document, their schedule)`` for a new snapshot: docs of
    unchanged files move over, elements of added/modified files are scheduled in dependency
    waves (refs: ``src_<id>``/``dst_<id>`` columns over the element ids)."""
    diff = snapshot_diff(old_files, new_files)
    carried = carry_forward(old_docs, diff, {"instance_key": new_key})
    todo = to_regenerate(new_elements.filter(~is_test_path(F.col("rel_path"))), diff)
    # Elements of unchanged files keep their docs; callers need not wait for those.
    kept = new_elements.select("element_id").join(todo.select("element_id"), "element_id", "left_anti")
    waves = doc_waves(todo.select("element_id"), refs, ["element_id"], kept)
    return carried, todo, waves


def refresh_history(files: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4 over the whole version history of all repositories: ``(docs of every snapshot, schedule)``.

    ``files``: (repo, number, rel_path, content) of all snapshots; ``docs``: (repo, number, rel_path, name, doc), written
    in the snapshot ``number``.  A file's docs are taken from the snapshot where its run of equal content
    began (``content_runs``), so each snapshot gets its docs in one join, however many snapshots back they
    were written; test paths have none.  The schedule holds, for each snapshot, the elements of files whose content began
    there, a name listed twice once (the first), with the wave in which each can be documented (callees in
    carried files count as done, see ``doc_waves``), its prompt with the code and docs of its callees, and
    ``over_budget``.  Both are keyed by ``instance_key`` = repo/number."""
    ensure_checkpoint_dir(files.sparkSession)
    key = F.concat_ws("/", "repo", F.col("number").cast("string"))
    files = files.filter(~is_test_path(F.col("rel_path")))
    runs = content_runs(files, ["repo"]).withColumn("instance_key", key).checkpoint()
    carried = (runs.withColumnRenamed("number", "_at").withColumnRenamed("since", "number")
               .join(shuffled(docs.groupBy("repo", "number", "rel_path", "name").agg(F.first("doc").alias("doc"))), ["repo", "number", "rel_path"])
               .select("instance_key", "rel_path", "name", "doc", F.col("number").alias("since")))
    snapshots = files.withColumn("instance_key", key).select(*KEY, "content")
    elements = build_code_catalog(snapshots).checkpoint()
    _, edges = build_import_graph(snapshots)
    top = elements.filter(F.col("node_key").isNotNull())
    internal = internal_imports(edges, snapshots, INST)
    refs = callee_refs(element_calls(top, KEY), internal, callables(elements, KEY), INST).checkpoint()
    new = top.join(shuffled(runs.filter(F.col("since") == F.col("number")).select(*KEY)), KEY, "left_semi")
    # A name that a file lists twice is documented once.
    todo = first_doc_wins(new.withColumn("at", F.struct("start_line", "col")), [*KEY, "name"], "at",
                          ["start_line", "kind", "signature", "content"]).drop("at").checkpoint()
    ids = [*KEY, "start_line"]
    old = top.join(shuffled(new.select(*ids)), ids, "left_anti").select(*ids)
    pairs = refs.select("instance_key", F.col("src_path").alias("src_rel_path"), F.col("start_line").alias("src_start_line"),
                        F.col("dst_path").alias("dst_rel_path"), F.col("callee_line").alias("dst_start_line"))
    pairs = pairs.select(F.col("instance_key").alias("src_instance_key"), F.col("instance_key").alias("dst_instance_key"), "src_rel_path",
                         "src_start_line", "dst_rel_path", "dst_start_line")
    waves = doc_waves(todo.select(*ids), pairs, ids, old)
    known = elements.join(shuffled(carried), [*KEY, "name"]).select(*ids, "doc")
    context = reference_context(refs, elements, known, INST).select("instance_key", F.col("src_path").alias("rel_path"), "start_line", "context")
    prompt = X.render_prompt(DOC_PROMPT, "kind", "name", "rel_path", F.concat_ws("\n", "signature", "content"), F.coalesce("context", F.lit("")))
    plan = todo.join(shuffled(waves), ids).join(shuffled(context), ids, "left").withColumn("prompt", prompt)
    plan = plan.withColumn("over_budget", ~X.within_budget(X.token_count("prompt"), PROMPT_BUDGET, strict=False))
    return carried, plan.select(*ids, "name", "level", "forced", "prompt", "over_budget")


def summarise_files(element_docs: DataFrame, budget: int = PROMPT_BUDGET) -> DataFrame:
    """C5: per file the numbered code descriptions of its elements, as a prompt; ``over_budget`` marks prompts too long to send."""
    sec = element_docs.withColumn("section", X.doc_section("doc"))
    desc = file_description(sec, KEY, "start_line", "section")
    prompt = X.render_prompt("Describe this %s file.\n%s", F.element_at(F.split("rel_path", r"\."), -1), "description")
    out = desc.withColumn("prompt", prompt).withColumn("tokens", X.token_count("prompt"))
    return out.withColumn("over_budget", ~X.within_budget(F.col("tokens"), budget, strict=False))


def index_chunks(file_docs: DataFrame) -> DataFrame:
    """C6, what is to be embedded: ``KEY + (pos, chunk, text_hash)``, chunks of the docs under their file name."""
    return with_text_hash(chunk_file_docs(file_docs), "chunk")


def issue_queries(analyses: DataFrame) -> DataFrame:
    """C6, the questions to be embedded: ``instance_key + (ordinal, query, text_hash)`` from the labelled lines of each
    issue analysis; empty ones are left out."""
    lines = analyses.select(*INST, F.posexplode(X.issue_fields("analysis")).alias("_p", "_s"))
    return with_text_hash(lines.select(*INST, (F.col("_p") + 1).alias("ordinal"), F.col("_s.value").alias("query")).filter("query <> ''"), "query")


def retrieve_files(file_docs: DataFrame, chunk_vectors: DataFrame, analyses: DataFrame, query_vectors: DataFrame, k: int = 50,
                   done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """C6 from docs to result: ``(files, report)``.

    Instances with both docs and an analysis are worked on, those in ``done`` not again.  Docs become chunks, the
    analysis becomes questions, vectors made elsewhere (``KEY + pos + text_hash``; ``instance_key + ordinal + text_hash``)
    are tied to them, and every question's ``k`` nearest chunks name its files: ``instance_key, rel_path, best_rank``.
    The report counts, per instance, chunks and questions, those without a vector, and vectors that no
    present text has."""
    ensure_checkpoint_dir(file_docs.sparkSession)
    work = ready_inputs(file_docs.select(*INST).distinct(), analyses, INST)
    work = (pending(work, done, INST) if done is not None else work).checkpoint()
    chunks = index_chunks(file_docs.join(work, INST, "left_semi")).checkpoint()
    asked = issue_queries(analyses.join(work, INST, "left_semi")).checkpoint()
    indexed, bare, stale = attach_vectors(chunks, chunk_vectors.join(work, INST, "left_semi"), [*KEY, "pos"])
    posed, unposed, unasked = attach_vectors(asked, query_vectors.join(work, INST, "left_semi"), [*INST, "ordinal"])
    indexed = indexed.withColumn("chunk_id", F.struct("rel_path", "pos"))
    hits = topk_similar(indexed.select(*KEY, "chunk_id", "embedding"), posed, INST, "chunk_id", "ordinal", k=k)
    counts = [(chunks, "chunks"), (bare, "chunks_without_vector"), (stale, "vectors_without_chunk"), (asked, "questions"),
              (unposed, "questions_without_vector"), (unasked, "vectors_without_question")]
    rows = None
    for df, name in counts:
        one = df.select(*INST, F.lit(name).alias("what"))
        rows = one if rows is None else rows.unionByName(one)
    tally = rows.groupBy(*INST).agg(*[F.count(F.when(F.col("what") == n, 1)).alias(n) for _, n in counts])
    report = work.join(tally, INST, "left").fillna(0)
    return retrieved_files(hits, INST, "rel_path"), report


def retrieved_texts(files: DataFrame) -> DataFrame:
    """C6's artefact: per instance its files, best rank first, one a line (``instance_key, text``)."""
    listed = files.groupBy(*INST).agg(F.array_sort(F.collect_list(F.struct("best_rank", "rel_path"))).alias("_f"))
    return listed.select(*INST, F.array_join(F.transform("_f", lambda f: F.concat(f["rel_path"], F.lit("\n"))), "").alias("text"))


def chunk_file_docs(file_docs: DataFrame) -> DataFrame:
    """C6 (first half): chunks of ``Filename: <path>`` + doc."""
    d = file_docs.withColumn("indexed", X.with_filename_header(F.col("rel_path"), F.col("doc")))
    return chunk_recursive(d, KEY, "indexed")


def file_contexts(retrieved: DataFrame, files: DataFrame, file_docs: DataFrame, budget_col: str | None = None,
                  budget: int = PROMPT_BUDGET) -> DataFrame:
    """C7: retrieved paths matched to snapshot files, summaries attached (``None`` when missing),
    deduplicated and packed into prompt batches."""
    matched = match_paths(retrieved.withColumnRenamed("rel_path", "needle"), files.select(*KEY), INST, "needle")
    ctx = attach_docs(matched.select(*KEY).distinct(), file_docs, KEY)
    ctx = ctx.withColumn("summary", X.file_summary_text("doc"))
    ctx = distinct_knowledge(ctx.withColumn("_o", F.lit(0)), [*KEY, "summary"], "_o")
    item = F.concat(F.lit("* `"), F.col("rel_path"), F.lit("`: \n"), F.col("summary"), F.lit("\n\n"))
    ctx = ctx.withColumn("item", item).withColumn("tokens", X.token_count("item"))
    return pack_batches(ctx, INST, ["rel_path"], "tokens", budget=budget_col or budget)


def element_contexts(answers: DataFrame, files: DataFrame, element_docs: DataFrame, meta: DataFrame,
                     budgets: DataFrame | None = None, budget: int = PROMPT_BUDGET) -> DataFrame:
    """C8: localised files (fenced lines of the file answer, test paths dropped) matched to files; each file's element
    docs with their types and summaries become one item, equal items count once, and items are packed into
    batches.  ``budgets`` (instance_key, text_budget; as ``media_budget`` returns them) states what images leave each
    instance; instances without a row have ``budget``.  Rows ``KEY + (item, tokens, idx, batch_no, oversize)``."""
    ranked = ranked_files(answers, INST, "answer").filter(~is_test_path(F.col("rel_path")))
    matched = match_paths(ranked.withColumnRenamed("rel_path", "needle"), files.select(*KEY), INST, "needle")
    docs = docs_for_file(element_docs, matched.select(*KEY).distinct(), KEY)
    docs = attach_element_type(docs, meta, [*KEY, "name"]).withColumn("summary", X.doc_summary("doc"))
    element = F.format_string("-- %s `%s` --\n\n%s\n\n", "type", "name", F.coalesce("summary", F.lit("None")))
    listed = docs.withColumn("element", element).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("name", "element"))).alias("_e"))
    text = F.array_join(F.transform("_e", lambda e: e["element"]), "")
    items = listed.select(*KEY, F.concat(F.lit("--- "), F.col("rel_path"), F.lit(" ---\n\n"), text, F.lit("\n\n")).alias("item"))
    items = distinct_knowledge(items, [*INST, "item"], "rel_path").withColumn("tokens", X.token_count("item"))
    room = F.lit(budget).cast("long")
    if budgets is not None:
        items, room = items.join(budgets.select(*INST, "text_budget"), INST, "left"), F.coalesce(F.col("text_budget").cast("long"), room)
    return pack_batches(items.withColumn("_room", room), INST, ["rel_path"], "tokens", budget="_room").select(
        *KEY, "item", "tokens", "idx", "batch_no", "oversize")


def element_prompts(contexts: DataFrame, statements: DataFrame) -> DataFrame:
    """C8's prompts: per instance and batch the issue and the batch's items (``instance_key, batch_no, prompt``);
    a batch's text is bounded by its budget."""
    batches = contexts.groupBy(*INST, "batch_no").agg(F.array_sort(F.collect_list(F.struct("idx", "item"))).alias("_i"))
    issue, _ = attach_instance(batches, statements.select(*INST, "problem_statement"), INST)
    knowledge = F.array_join(F.transform("_i", lambda i: i["item"]), "\n")
    return issue.select(*INST, "batch_no", X.render_prompt(ELEMENT_PROMPT, F.coalesce("problem_statement", F.lit("")), knowledge).alias("prompt"))


def repair_contexts(answers: DataFrame, files: DataFrame, elements: DataFrame, done: DataFrame | None = None,
                    budget: int = PROMPT_BUDGET, statements: DataFrame | None = None, budgets: DataFrame | None = None) -> DataFrame:
    """C9: buggy elements from the element answers of instances that have files, paths matched, each file's text
    pruned to the buggy elements, equal records once; with ``statements`` the repair prompt, and ``over_budget`` where
    it exceeds what images leave (``budgets`` as in ``element_contexts``).  Files in ``done`` (a patch exists) are
    skipped; other files of their instance stay."""
    answers = ready_inputs(answers, files, INST)
    want = fenced_elements(answers, INST, "answer")
    matched = match_paths(want.select(*INST, F.col("rel_path").alias("needle")).distinct(), files.select(*KEY),
                          INST, "needle")
    # Paths, elements and texts are as many as the files, whatever the planner guesses: none of them is broadcast.
    keep = matched.join(shuffled(want.withColumnRenamed("rel_path", "needle")), [*INST, "needle"]).select(
        *KEY, F.col("element").alias("name")).distinct().withColumn("keep", F.lit(True))
    el = elements.filter(F.col("node_key").isNotNull()).join(shuffled(keep), [*KEY, "name"], "left") \
        .withColumn("keep", F.coalesce("keep", F.lit(False))) \
        .select(*KEY, F.struct("start_line", "col").alias("at"), "signature", F.col("content").alias("text"), "keep")
    pruned = prune_context(files.join(shuffled(matched.select(*KEY).distinct()), KEY), el, KEY, "keep", "at", "content")
    pruned = distinct_knowledge(pruned.withColumn("_o", F.lit(0)), [*KEY, "pruned"], "_o").drop("_o")
    prompt = F.format_string("###%s\n\n%s", "rel_path", "pruned")
    if statements is not None:
        issue = statements.select(*INST, "problem_statement")
        pruned, prompt = pruned.join(issue, INST), X.render_prompt(REPAIR_PROMPT, F.coalesce("problem_statement", F.lit("")), prompt)
    room = F.lit(budget).cast("long")
    if budgets is not None:
        pruned, room = pruned.join(budgets.select(*INST, "text_budget"), INST, "left"), F.coalesce(F.col("text_budget").cast("long"), room)
    out = pruned.withColumn("prompt", prompt).withColumn("tokens", X.token_count("prompt"))
    out = out.withColumn("over_budget", F.col("tokens") > room).select(*KEY, "pruned", "prompt", "tokens", "over_budget")
    return out if done is None else pending(out, shuffled(done), KEY)


def media_budget(assets: DataFrame, frames: DataFrame, budget: int = PROMPT_BUDGET) -> DataFrame:
    """C10: image tokens per instance and the prompt budget left for text."""
    t = instance_image_tokens(assets, frames, INST)
    return t.withColumn("text_budget", F.lit(budget) - F.col("image_tokens"))


def sample_keyframes(frames: DataFrame, threshold: float = 1 - SIMILARITY_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """C11: key frames of every gif (``gif``, ``frame_no``, ``feature``; ``instance_key`` where frames
    have it, as gifs of two instances may share a name) and saved/total counts."""
    gif = [*(c for c in INST if c in frames.columns), "gif"]
    kept = keyframes(frames, gif, ["frame_no"], "feature", threshold=threshold)
    return kept, keyframe_counts(kept, frames, gif)
