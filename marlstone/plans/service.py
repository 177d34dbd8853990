"""The seven operations over a corpus: describe, resolve, query, search, read, related, graph.

``Service.execute`` takes an operation and its arguments and returns an envelope: results, counts, cursor, budget, coverage,
snapshot, plan, and the stages that were left out. What reaches the driver is one page (limit + 1 rows), a bounded shortlist or a
bounded walk; everything before it is a plan. Pages belong to an immutable generation of the catalogue (``snapshots``): a cursor
names it, its request and its place, and carries the total, so that no page counts again. Errors carry a code.
"""

from __future__ import annotations

import base64
import hashlib
import json
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BLOCKS, ENTITIES, MODEL, PAGES, entities, pages
from ..operators import retrieval
from ..operators.catalog import after, group_counts, ordering
from ..operators.filters import FIELDS, METADATA, InvalidArgument, apply_filter, combine, is_date, validate
from ..operators.graph import traverse
from ..operators.mentions import RELATIONS, find, mentions, resolved
from ..operators.networks import edges, seed
from ..operators.pages import CANDIDATES, frozen, only, outline, selected, within_budget
from ..operators.retrieval import fused, lexical, scratch
from ..operators.windows import first_per
from ..registry import registry
from .snapshots import Snapshots

QUERIES, SQL, query = registry()
#: Operations, and the arguments each takes beside the common ones (query_vector is this library's own: the caller
#: embeds the query).
OPERATIONS = {
    "describe": {"section", "q"},
    "resolve": {"q", "kind", "entity_type"},
    "query": {"q", "sort", "direction", "fields", "group_by"},
    "search": {"query", "mode", "group_by", "explain", "expected_id", "entity_name", "entity_type", "query_vector"},
    "read": {"id", "revision_id", "view", "page", "block_id", "start_block", "find", "neighbors"},
    "related": {"id", "direction", "link_types", "depth", "max_nodes", "max_edges"},
    "graph": {"operation", "seed", "seeds", "direction", "relation_types", "depth", "max_nodes", "max_edges", "group_by", "relation_as_of"},
}
COMMON = {"filters", "limit", "cursor", "max_response_tokens", "timeout_ms"}
SORTS = ("title", *[f for f, kind in METADATA.items() if kind == "date"])
#: Arguments that may change from page to page, and seconds that a cursor lives.
FREE, TTL = {"cursor", "limit", "max_response_tokens", "timeout_ms"}, 600
DOCUMENT_RELATIONS = ("supported_by",)
#: What of a document may be shown beside its metadata.
IDENTITY = {"slug", "revision_id", "family_id"}
#: Of each session and corpus: the folder of its snapshots, and what the files of its documents looked like when it was published.
_ROOTS: dict[str, list] = {}
_LOCK = threading.Lock()


def metadata(docs: DataFrame) -> DataFrame:
    """Pages with the catalogue's fields. What a page has no value for is missing, and so are fields that no page has."""
    n = F.col("doc_id")
    day = lambda k: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % k).cast("int")), "yyyy-MM-dd")
    of_tag = lambda prefix: F.transform(F.filter("tags", lambda t: F.startswith(t, F.lit(prefix))), lambda t: F.trim(F.substring(t, len(prefix) + 1, 500)))
    return docs.select(
        "*",
        of_tag("行业:").alias("industries"),
        F.array_compact(F.array("institution")).alias("institutions"),
        F.when(n % 3 != 0, F.array(F.concat(F.lit("Author "), n % 13))).alias("authors"),
        F.when(F.size("tickers") > 0, F.array(F.lit("HK"))).alias("markets"),
        F.when(F.startswith("slug", F.lit("sources/")), "source").when(F.startswith("slug", F.lit("notes/")), "note").otherwise("wiki").alias("page_type"),
        F.col("category").alias("research_category"),
        F.col("lang").alias("language"),
        F.col("stage").alias("research_stage"),
        F.when(n % 2 == 0, "reviewed").alias("review_status"),
        F.when(n % 3 == 0, day(200)).alias("data_as_of"),
        day(300).alias("ingested_at"),
    )


def issued(registry_: DataFrame) -> DataFrame:
    """Securities and their issuers as dated facts: valid from a day (unknown for some), until a day (for some), observed on a day."""
    k = F.col("code").cast("int")
    date = lambda text: F.lit(text).cast("date")
    return registry_.where("issuer_id is not null").select(
        F.col("entity_id").alias("source_id"),
        F.col("issuer_id").alias("target_id"),
        F.lit("issued_by").alias("relation_type"),
        F.concat(F.lit("r:"), "entity_id").alias("relation_id"),
        F.when(k % 4 != 0, date("2024-01-01")).alias("valid_from"),
        F.when((k % 4 != 0) & (k % 5 == 0), date("2024-06-30")).alias("valid_to"),
        F.when(k % 3 == 0, date("2025-01-01")).otherwise(date("2023-01-01")).alias("observed_at"),
    )


def _hash(request: dict) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Service:
    """Operations over one corpus. The catalogue is published once a session, and again by ``publish``."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str | None = None, clock=time.time):
        self.spark, self.sf_dir, self.clock = spark, sf_dir, clock
        key = root or f"{spark.sparkContext.applicationId}|{sf_dir}"
        with _LOCK:
            self._kept = _ROOTS.setdefault(key, [root or f"{scratch(spark)}/service-{uuid.uuid4().hex}", None, {}])
        self.snapshots = Snapshots(spark, self._kept[0])
        self.registry = entities(spark, sf_dir)

    def _members(self) -> DataFrame:
        return resolved(mentions(pages(self.spark, self.sf_dir)), self.registry)

    def publish(self) -> int:
        """A new generation of the catalogue, with the entities of each document frozen, and its new revisions."""
        docs = pages(self.spark, self.sf_dir)
        members = self._members().where("entity_id is not null").select("document_id", "entity_id").distinct()
        live = docs.where(~F.col("deleted"))
        files = retrieval._files(self.spark, f"{self.sf_dir}/documents.parquet")
        number = self.snapshots.publish(frozen(metadata(live.drop("text")), members), live.select("document_id", "revision_id", "title", "tags", "published_at", "text"))
        self._kept[1] = files
        return number

    def _current(self) -> int:
        with _LOCK:
            have = self.snapshots.generations() if self._kept[1] is not None else []
            return have[-1] if have else self.publish()

    def execute(self, operation: str, /, **args) -> dict:
        if operation not in OPERATIONS:
            raise InvalidArgument("UNKNOWN_OPERATION")
        if unknown := args.keys() - OPERATIONS[operation] - COMMON:
            raise InvalidArgument(f"INVALID_ARGUMENT: {sorted(unknown)}")
        limit = self._integer(args, "limit", 20, 1, 100)
        tokens = self._integer(args, "max_response_tokens", 6000, 512, 32_000)
        timeout = self._integer(args, "timeout_ms", 15_000, 100, 120_000)
        if args.get("filters") is not None:
            validate(args["filters"])
        began, request = time.time(), {"operation": operation} | {k: v for k, v in args.items() if k not in FREE}
        opened = self._opened(args["cursor"], request) if args.get("cursor") is not None else {"snapshot": self._current(), "place": None, "total": None}
        self.snapshot, self.place, self.total = opened["snapshot"], opened["place"], opened["total"]
        self.docs = self.snapshots.catalogue(self.snapshot, [self.snapshot])  # found a moment ago
        with self._limited(timeout if "timeout_ms" in args else None):
            found, coverage = getattr(self, operation)(args, limit), self._coverage(args)
        rows, more = found.pop("results")
        results, over = within_budget(rows, tokens)
        more = more or over
        place = found.pop("place", lambda row, n: (self.place or 0) + n)
        total = found.pop("total", None)
        degraded = found.pop("degraded", [])
        if not coverage["complete"]:
            degraded = [{"stage": "catalog", "reason": "index_incomplete"}, *degraded]
        expires = self.clock() + TTL
        body = {"h": _hash(request), "s": self.snapshot, "e": expires, "p": place(results[-1], len(results)) if results else None, "t": total}
        return {
            "results": results,
            "returned_count": len(results),
            "truncated": more,
            "next_cursor": base64.urlsafe_b64encode(json.dumps(body).encode()).decode() if more and results else None,
            "cursor_expires_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(expires)),
            "budget": {"max_response_tokens": tokens, "cut": over, "method": "2_characters_per_token_estimate"},
            "snapshot_id": str(self.snapshot),
            "coverage": coverage,
            "degraded": degraded,
            "query_plan": {"operation": operation, "filters": args.get("filters"), "missing_values": "excluded_from_positive_filters"} | found.pop("plan", {}),
            "schema_version": 1,
            "request_id": uuid.uuid4().hex,
            "latency_ms": round(1000 * (time.time() - began)),
            **({"total": total, "total_count": total} if total is not None else {}),
            **found,
        }

    @contextmanager
    def _limited(self, timeout: int | None) -> Iterator[None]:
        """Cancels the jobs of what runs inside after timeout milliseconds; their failure is then TIMEOUT."""
        if timeout is None:
            yield
            return
        context, tag, late = self.spark.sparkContext, f"service-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout / 1000, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            yield
        except InvalidArgument:
            raise
        except Exception as error:
            if late.is_set():
                raise InvalidArgument("TIMEOUT") from error
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        if late.is_set():
            raise InvalidArgument("TIMEOUT")

    @staticmethod
    def _integer(args: dict, name: str, default: int, low: int, high: int) -> int:
        value = args.get(name, default)
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise InvalidArgument(f"INVALID_ARGUMENT: {name}")
        return value

    @staticmethod
    def _text(args: dict, name: str, most: int = 1000) -> str:
        value = args.get(name)
        if not isinstance(value, str) or not value.strip() or len(value) > most:
            raise InvalidArgument(f"INVALID_ARGUMENT: {name}")
        return value.strip()

    @staticmethod
    def _one_of(args: dict, name: str, default, allowed) -> str:
        value = args.get(name, default)
        if value not in allowed:
            raise InvalidArgument(f"INVALID_ARGUMENT: {name}")
        return value

    def _opened(self, cursor: str, request: dict) -> dict:
        try:
            body = json.loads(base64.urlsafe_b64decode(cursor))
            opened = {"snapshot": body["s"], "place": body["p"], "total": body["t"]}
            expires, asked = float(body["e"]), body["h"]
        except Exception as error:
            raise InvalidArgument("INVALID_CURSOR") from error
        if asked != _hash(request):
            raise InvalidArgument("CURSOR_MISMATCH")
        if expires < self.clock() or opened["snapshot"] not in self.snapshots.generations():
            raise InvalidArgument("CURSOR_EXPIRED")
        return opened

    def docs_of(self, id_: str) -> DataFrame:
        """Catalogue rows of an id in the current generation."""
        return self.snapshots.catalogue(self._current()).where(F.col("document_id") == id_)

    def _scope(self, args: dict) -> DataFrame:
        return apply_filter(self.docs, args.get("filters"))

    def _coverage(self, args: dict) -> dict:
        """Documents in the scope, counted once for a generation and filter, and whether the catalogue is of the files as they are now."""
        key, counts = (self.snapshot, json.dumps(args.get("filters"), sort_keys=True)), self._kept[2]
        if key not in counts:
            if len(counts) >= 128:
                counts.pop(next(iter(counts)))
            counts[key] = self._scope(args).count()
        complete = self._kept[1] == retrieval._files(self.spark, f"{self.sf_dir}/documents.parquet")
        return {"documents": counts[key], "complete": complete, "snapshot_id": str(self.snapshot)}

    def _page(self, rows: DataFrame, limit: int) -> tuple[list[dict], bool]:
        """One page of ordered rows, by offset, and whether there are more."""
        got = [r.asDict(recursive=True) for r in rows.offset(self.place or 0).limit(limit + 1).collect()]
        return got[:limit], len(got) > limit

    def _sliced(self, rows: list[dict], limit: int) -> tuple[list[dict], bool]:
        at = self.place or 0
        return rows[at : at + limit], len(rows) > at + limit

    def describe(self, args: dict, limit: int) -> dict:
        if self._one_of(args, "section", "capabilities", ("capabilities", "tags")) == "capabilities":
            rows = [{"operation": o, "arguments": sorted(a | COMMON)} for o, a in OPERATIONS.items()]
            return {"results": self._sliced(rows, limit), "fields": FIELDS, "limits": {"max_results_per_page": 100, "max_filter_nodes": 100, "cursor_ttl_seconds": TTL}, "relations": [*DOCUMENT_RELATIONS, *RELATIONS]}
        tags = group_counts(self._scope(args), "tags", True).where(F.contains(F.lower("value"), F.lit(args.get("q", "").lower())))
        rows = tags.orderBy(F.desc("n"), "value").select(F.col("value").alias("tag"), F.concat(F.lit("tag:"), F.substring(F.sha2("value", 256), 1, 24)).alias("tag_id"), "n")
        return {"results": self._page(rows, limit), "total": self.total if self.total is not None else tags.count()}

    def resolve(self, args: dict, limit: int) -> dict:
        q, kind = self._text(args, "q"), self._one_of(args, "kind", "document", ("document", "tag", "entity"))
        if args.get("entity_type") is not None and kind != "entity":
            raise InvalidArgument("INVALID_ARGUMENT: entity_type")
        if kind == "entity":
            known = self._scope(args).select("document_id", F.explode("entity_ids").alias("entity_id"))
            counts = known.groupBy("entity_id").agg(F.countDistinct("document_id").alias("documents"))
            rows = find(q, self.registry, counts, self.spark.createDataFrame([], "type string, alias string, entity_id string"), args.get("entity_type"))
        elif kind == "tag":
            tags = self._scope(args).select(F.explode("tags").alias("label")).distinct()
            rows = tags.where(F.contains(F.lower("label"), F.lit(q.lower()))).select("label", (F.lower("label") == q.lower()).alias("exact")).orderBy(F.desc("exact"), "label")
        else:
            hit = F.contains(F.lower("title"), F.lit(q.lower())) | (F.lower("document_id") == q.lower()) | (F.lower("slug") == q.lower())
            exact = (F.lower("title") == q.lower()) | (F.lower("document_id") == q.lower()) | (F.lower("slug") == q.lower())
            rows = self._scope(args).where(hit).select("document_id", "title", exact.alias("exact")).orderBy(F.desc("exact"), "title", "document_id")
        total = self.total if self.total is not None else rows.count()  # in the tasks: a page is shown however many there are
        return {"results": self._page(rows, limit), "total": total, "ambiguous": total > 1}

    def query(self, args: dict, limit: int) -> dict:
        docs = self._scope(args)
        if args.get("q") is not None:
            q = self._text(args, "q").lower()
            docs = docs.where(F.contains(F.lower(F.concat_ws(" ", "document_id", "title", "slug", F.array_join("tags", " "))), F.lit(q)))
        if group := args.get("group_by"):
            if group not in FIELDS:
                raise InvalidArgument("INVALID_ARGUMENT: group_by")
            column = F.col(group) if group in docs.columns else F.lit(None).cast("array<string>" if FIELDS[group] == "array" else "string")
            rows = group_counts(docs.select("document_id", column.alias("_g")), "_g", FIELDS[group] == "array").orderBy(F.desc("n"), F.asc_nulls_last("value"))
            return {"results": self._page(rows, limit)}
        sort, down = self._one_of(args, "sort", "published_at", SORTS), self._one_of(args, "direction", "desc", ("asc", "desc")) == "desc"
        fields = list(dict.fromkeys(["document_id", "title", sort, *args.get("fields", [])]))
        if unknown := set(fields) - set(FIELDS) - IDENTITY:
            raise InvalidArgument(f"INVALID_ARGUMENT: {sorted(unknown)}")
        total = self.total if self.total is not None else docs.count() if args.get("q") is not None else self._coverage(args)["documents"]
        page = docs if self.place is None else docs.where(after(sort, down, self.place[0], self.place[1]))
        shown = [F.col(f) if f in docs.columns else F.lit(None).cast("string").alias(f) for f in fields]
        rows = [r.asDict(recursive=True) for r in page.orderBy(*ordering(sort, down)).select(*shown).limit(limit + 1).collect()]
        return {"results": (rows[:limit], len(rows) > limit), "total": total, "place": lambda row, _: [row[sort], row["document_id"]], "plan": {"pagination": "immutable_catalog_keyset", "sort": sort, "direction": "desc" if down else "asc"}}

    def search(self, args: dict, limit: int) -> dict:
        self._text(args, "query")
        for name, allowed in (("mode", tuple(CANDIDATES)), ("group_by", ("document", "document_family", "passage")), ("explain", (True, False))):
            if args.get(name) is not None:
                self._one_of(args, name, None, allowed)
        if args.get("entity_name") is None:
            if args.get("entity_type") is not None:
                raise InvalidArgument("INVALID_ARGUMENT: entity_type")
            found = self._search(args)
            return found | {"results": self._sliced(found["results"], limit)}
        # The scope of a confirmed entity first, with what was asked; then the name itself, as leads that need evidence.
        name, candidates, confirmed = self._named(args)
        lead = args | {"query": name, "mode": "lexical", "query_vector": None}
        batches = []
        if confirmed:
            batches.append((self._search(args | {"filters": self._of(confirmed, args)}), "confirmed_membership", "confirmed_entity_scope"))
        batches.append((self._search(lead), "needs_evidence", "raw_name_fallback"))
        results, seen = [], {}
        for found, identity, route in batches:
            for hit in found["results"]:
                key = {"document_family": hit["family_id"], "passage": (hit["document_id"], hit["ordinal"])}.get(args.get("group_by"), hit["document_id"])
                if key not in seen and sum(d == hit["document_id"] for d in seen.values()) < (3 if args.get("group_by") == "passage" else 1):
                    seen[key] = hit["document_id"]
                    results.append(hit | {"identity_status": identity, "retrieval_route": route})
        first = batches[0][0]
        degraded = [d for found, *_ in batches for d in found["degraded"]]
        status = "resolved" if confirmed else "unresolved_or_ambiguous"
        return first | {"results": self._sliced(results, limit), "degraded": degraded, "entity_retrieval": {"name": name, "entity_id": confirmed, "status": status, "candidates": candidates[:20], "candidates_truncated": len(candidates) > 20}}

    def _named(self, args: dict) -> tuple[str, list[dict], str | None]:
        """The name that is asked for, the entities that may be meant (21 at most), and the one that is, if there is no other."""
        name = self._text(args, "entity_name", 500)
        candidates = find(name, self.registry, self.spark.createDataFrame([], "entity_id string, documents long"), self.spark.createDataFrame([], "type string, alias string, entity_id string"), args.get("entity_type"))
        candidates = [r.asDict() for r in candidates.limit(21).collect()]
        exact = [c for c in candidates if c["exact"]]
        return name, candidates, exact[0]["entity_id"] if len(candidates) == 1 and len(exact) == 1 else None

    @staticmethod
    def _of(entity: str, args: dict) -> dict:
        return combine(args.get("filters"), {"field": "entity_ids", "op": "contains_all", "value": [entity]})

    def matching(self, **args) -> DataFrame:
        """document_id, identity_status of every document of a confirmed entity that a lexical search (query, entity_name, entity_type,
        filters) matches: a plan over the postings, where ``search`` shows pages of a bounded shortlist. Without such an entity, none."""
        if args.get("filters") is not None:
            validate(args["filters"])
        self.snapshot = self._current()
        self.docs = self.snapshots.catalogue(self.snapshot, [self.snapshot])
        *_, confirmed = self._named(args)
        scope = self._scope({"filters": self._of(confirmed, args)}) if confirmed else self.docs.limit(0)
        found, _ = lexical(self.spark, self.sf_dir, self._text(args, "query"), None, None, scope)
        return found.matched.select("document_id", F.lit("confirmed_membership").alias("identity_status"))

    def _search(self, args: dict) -> dict:
        q, mode, began = args["query"], args.get("mode") or "hybrid", time.time()
        group, most = {"document": ("document_id", 1), "document_family": ("family_id", 1), "passage": ("document_id", 3)}[args.get("group_by") or "document"]
        docs, degraded, times = self._scope(args), [], {}
        found, how = lexical(self.spark, self.sf_dir, q, None, CANDIDATES[mode], docs)
        found.top()
        times["lexical_ms"] = round(1000 * (time.time() - began))
        channels = []
        if found.top():
            passages = found.passages()
            channels = [(name, passages.where(F.col("channel") == name).select("document_id", "ordinal", "score")) for name in ("lexical", "metadata")]
        if mode == "deep":
            degraded.append({"stage": "deep", "reason": "llm_expansion_and_reranker_not_configured; increased_candidate_pool_only"})
        vector = args.get("query_vector")
        if mode != "lexical" and vector is None:
            degraded.append({"stage": "embedding_or_vector", "reason": "QUERY_VECTOR_MISSING"})
        elif mode != "lexical" and found.top():
            channels.append(("vector", found.vectors([float(x) for x in vector])))
        results = []
        if channels:
            ranked = fused(channels).join(docs.select("document_id", "revision_id", "family_id", "title"), "document_id")
            kept = first_per(ranked, [group], [F.desc("score"), "document_id", "ordinal"], most)
            # The evidence of the active revision only: a block of another one is not shown.
            text = found.blocks().select("document_id", "revision_id", "ordinal", F.substring("text", 1, 700).alias("snippet"))
            rows = kept.join(text, ["document_id", "revision_id", "ordinal"], "left").orderBy(F.desc("score"), "document_id", "ordinal")
            citation = F.when(F.col("snippet").isNotNull(), "available").otherwise("read_required").alias("citation_status")
            results = [r.asDict() for r in rows.select("document_id", "family_id", "ordinal", "title", "channels", F.round("score", 12).alias("score"), citation, "snippet").collect()]
        out = {"results": results, "total_is_exhaustive": False, "degraded": degraded, "candidate_count": len(results)}
        out["plan"] = {"mode": mode, "candidate_limit": CANDIDATES[mode], "lexical_match": how, "matched_documents": found.total, "candidate_truncated": found.total > CANDIDATES[mode], "score": "RRF_not_probability"}
        scoped = self._coverage(args)["documents"]
        out["empty_reason"] = None if results else "no_documents_match_filters" if not scoped else "retrieval_incomplete" if degraded else "no_match_in_searched_text"
        expected = args.get("expected_id")
        if expected is not None:
            passes = docs.where(F.col("document_id") == expected).limit(1).count() > 0
            out["expected"] = {"passes_filters": passes, "shortlisted": expected in {i for i, _ in found.top()}}
        if args.get("explain"):
            near = expected is not None and any(name == "vector" and rows.where(F.col("document_id") == expected).limit(1).count() for name, rows in channels)
            out["plan"] |= {"timings": times | {"total_ms": round(1000 * (time.time() - began))}, "lexical_candidates": len(found.top())}
            if expected is not None:
                out["plan"]["expected"] = {"id": expected, "in_lexical_candidates": expected in {i for i, _ in found.top()}, "in_vector_candidates": bool(near), "in_results": any(r["document_id"] == expected for r in results)}
        return out

    def read(self, args: dict, limit: int) -> dict:
        id_, view = self._text(args, "id", 500), self._one_of(args, "view", "outline", ("metadata", "outline", "blocks"))
        document = only(self.docs, (F.col("document_id") == id_) | (F.col("slug") == id_))
        wanted = args.get("revision_id", document["revision_id"])
        revision = self.snapshots.revision(document["document_id"], wanted)
        base = {"document": {k: document[k] for k in ("document_id", "slug", "title")}, "revision_id": wanted, "current_revision": wanted == document["revision_id"]}
        if view == "metadata":
            return base | {"results": ([{k: revision[k] for k in ("document_id", "revision_id", "title", "tags", "published_at")}], False)}
        own = self.snapshots.blocks(document["document_id"], wanted)
        if view == "outline":
            return base | {"results": self._page(outline(own).orderBy("ordinal").select("ordinal", "pdf_page", "section"), limit)}
        start = self._integer(args, "start_block", 0, 0, 1_000_000)
        neighbors = self._integer(args, "neighbors", 0, 0, 3)
        page = self._integer(args, "page", 1, 1, 100_000) if args.get("page") is not None else None
        if args.get("block_id") is not None and own.where(F.col("block_id") == args["block_id"]).limit(1).count() == 0:
            raise InvalidArgument("BLOCK_NOT_FOUND")
        total = self.total if self.total is not None else own.count()
        rows = selected(own, start, page, args.get("block_id"), args.get("find"), neighbors).orderBy("ordinal").select("block_id", "ordinal", "pdf_page", "section", "text")
        return base | {"results": self._page(rows, limit), "total": total, "total_blocks": total}

    def _edges(self, args: dict, types: list[str] | None, allowed: tuple[str, ...]) -> DataFrame:
        """Edges of the documents in scope by type; business relations as of a day, and with a filter only between entities in scope."""
        if types is not None and (not isinstance(types, list) or set(types) - set(allowed)):
            raise InvalidArgument("INVALID_ARGUMENT: relation types")
        day = args.get("relation_as_of")
        if day is not None and not is_date(day):
            raise InvalidArgument("INVALID_ARGUMENT: relation_as_of")
        facts = issued(self.registry)
        if day is not None:
            at = F.lit(day).cast("date")
            facts = facts.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at)) & (F.col("observed_at") <= at))
        scope = self._scope(args).withColumn("deleted", F.lit(False))
        if args.get("filters") is not None:
            named = scope.select(F.explode("entity_ids").alias("id")).distinct()
            facts = facts.join(named.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(named.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        graph = edges(scope, resolved(mentions(scope.drop("industries")), self.registry), facts)  # industries are those of the tags
        return graph.where(F.col("type").isin(list(types or allowed)))

    def _walk(self, graph: DataFrame, start: str, args: dict, limit: int) -> dict:
        depth, nodes, most = self._integer(args, "depth", 1, 1, 2), self._integer(args, "max_nodes", 100, 2, 400), self._integer(args, "max_edges", 300, 1, 1000)
        direction = self._one_of(args, "direction", "both", ("both", "outgoing", "incoming"))
        seen, taken, cut = traverse(graph, start, depth, nodes, most, direction)
        rows = [dict(zip(("source", "target", "type", "provenance"), e)) for e in taken]
        reason = "node_or_edge_budget; narrow filters or query a returned node" if cut else None
        return {"results": self._sliced(rows, limit), "total": len(rows), "node_count": len(seen), "edge_count": len(rows), "traversal_truncated": cut, "truncation_reason": reason, "limits": {"depth": depth, "max_nodes": nodes, "max_edges": most}}

    def related(self, args: dict, limit: int) -> dict:
        id_ = self._text(args, "id", 500)
        start = only(self.docs.select("document_id", "slug"), (F.col("document_id") == id_) | (F.col("slug") == id_))["document_id"]
        return self._walk(self._edges(args, args.get("link_types"), DOCUMENT_RELATIONS), start, args, limit)

    def graph(self, args: dict, limit: int) -> dict:
        operation = self._one_of(args, "operation", "overview", ("overview", "neighbors", "intersection"))
        graph = self._edges(args, args.get("relation_types"), ("has_tag", "has_entity", *DOCUMENT_RELATIONS, *RELATIONS))
        if operation == "neighbors":
            if not isinstance(args.get("seed"), dict) or not {"kind", "id"} <= args["seed"].keys():
                raise InvalidArgument("INVALID_ARGUMENT: seed")
            node = seed(self._scope(args), self.registry, args["seed"]["kind"], args["seed"]["id"])
            return self._walk(graph, node["id"], args, limit) | {"seed": node}
        if operation == "intersection":
            seeds = args.get("seeds", [])
            if not isinstance(seeds, list) or not all(isinstance(s, dict) and s.get("kind") in ("tag", "entity") and "id" in s for s in seeds) or not 2 <= len({s["id"] for s in seeds}) <= 5:
                raise InvalidArgument("INVALID_ARGUMENT: seeds")
            out = self._scope(args).select("document_id", "title")
            for s in seeds:
                out = out.join(graph.where(F.col("target") == s["id"]).select(F.col("source").alias("document_id")), "document_id", "left_semi")
            total = self.total if self.total is not None else out.count()
            return {"results": self._page(out.orderBy("document_id"), limit), "total": total}
        group = self._one_of(args, "group_by", "tag", ("tag", "entity", "category"))
        if group == "category":
            rows = group_counts(self._scope(args), "category", False).select(F.coalesce("value", F.lit("unknown")).alias("target"), F.col("n").alias("documents"))
        else:
            rows = graph.where(F.col("type") == {"entity": "has_entity", "tag": "has_tag"}[group]).groupBy("target").agg(F.countDistinct("source").alias("documents"))
        return {"results": self._page(rows.orderBy(F.desc("documents"), "target"), limit)}


def _rows(spark, found: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in found], schema)


P = f"WITH {PAGES} "


@query("svc_describe", f"{P} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM pages_ WHERE NOT deleted) WHERE contains(tag, 'lang') GROUP BY 1 ORDER BY n DESC, tag LIMIT 20")
def describe(spark, sf_dir):
    return _rows(spark, Service(spark, sf_dir).execute("describe", section="tags", q="LANG")["results"], "tag string, n long")


@query("svc_resolve", f"{P} SELECT document_id, lower(title) = 'report 12' AS exact FROM pages_ WHERE NOT deleted AND contains(lower(title), 'report 12') ORDER BY exact DESC, title, document_id LIMIT 20")
def resolve(spark, sf_dir):
    return _rows(spark, Service(spark, sf_dir).execute("resolve", q="Report 12")["results"], "document_id string, exact boolean")


@query("svc_query_pages", f"{P} SELECT document_id FROM pages_ WHERE NOT deleted AND coalesce(lang = 'en', false) ORDER BY published_at DESC NULLS LAST, document_id LIMIT 30")
def query_pages(spark, sf_dir):
    """Three pages of ten by cursor."""
    service, args, out = Service(spark, sf_dir), {"filters": {"field": "lang", "op": "eq", "value": "en"}, "limit": 10}, []
    for _ in range(3):
        found = service.execute("query", **args)
        out += found["results"]
        if found["next_cursor"] is None:
            break
        args["cursor"] = found["next_cursor"]
    return _rows(spark, out, "document_id string")


@query("svc_query_groups", f"{P} SELECT value, count(*) AS n FROM (SELECT unnest(tags) AS value FROM pages_ WHERE NOT deleted) GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def query_groups(spark, sf_dir):
    return _rows(spark, Service(spark, sf_dir).execute("query", group_by="tags")["results"], "value string, n long")


@query("svc_search", f"{P} SELECT document_id FROM pages_ WHERE NOT deleted AND title = 'Report 13 from src13'")
def search(spark, sf_dir):
    """A title as the query: its document comes first."""
    found = Service(spark, sf_dir).execute("search", query="Report 13 from src13", mode="lexical", limit=1)
    return _rows(spark, found["results"], "document_id string")


@query("svc_read_blocks", f"{P} SELECT CAST(k AS INTEGER) AS ordinal, substr(text, CAST(1800 * k + 1 AS BIGINT), 1800) AS text FROM (SELECT text, unnest(range(CAST(ceil(length(text) / 1800.0) AS BIGINT))) AS k FROM pages_ WHERE document_id = 'doc:4') ORDER BY 1 LIMIT 20")
def read_blocks(spark, sf_dir):
    return _rows(spark, Service(spark, sf_dir).execute("read", id="doc:4", view="blocks", max_response_tokens=32_000)["results"], "ordinal int, text string")


@query("svc_read_metadata", f"{P} SELECT document_id, revision_id, title FROM pages_ WHERE document_id = 'doc:4'")
def read_metadata(spark, sf_dir):
    return _rows(spark, Service(spark, sf_dir).execute("read", id="doc:4", view="metadata")["results"], "document_id string, revision_id string, title string")


@query("svc_related", f"{P} SELECT a.document_id AS source, b.document_id AS target FROM pages_ a JOIN pages_ b ON b.slug = a.supported_by WHERE NOT a.deleted AND NOT b.deleted AND (a.document_id = 'doc:2' OR b.document_id = 'doc:2')")
def related(spark, sf_dir):
    return _rows(spark, Service(spark, sf_dir).execute("related", id="doc:2")["results"], "source string, target string")


@query("svc_graph_intersection", MODEL + "SELECT document_id FROM pages_ WHERE NOT deleted AND list_contains(tags, 'src:src4') AND document_id IN (SELECT document_id FROM resolved_ WHERE entity_id = 'entity:security:5') ORDER BY document_id LIMIT 20")
def graph_intersection(spark, sf_dir):
    tag = spark.range(1).select(F.concat(F.lit("tag:"), F.substring(F.sha2(F.lit("src:src4"), 256), 1, 24)).alias("t")).first()["t"]
    found = Service(spark, sf_dir).execute("graph", operation="intersection", seeds=[{"kind": "tag", "id": tag}, {"kind": "entity", "id": "entity:security:5"}])
    return _rows(spark, found["results"], "document_id string")


@query("svc_query_total", f"{P}, n AS (SELECT count(*) AS n FROM pages_ WHERE NOT deleted AND coalesce(lang = 'en', false)) SELECT page, least(40, n - 40 * (page - 1)) AS returned, n AS total, n > 40 * page AS truncated FROM n, (SELECT unnest([1, 2]) AS page)")
def query_total(spark, sf_dir):
    """The total is counted once, and the cursor carries it; the last page says that it is whole."""
    service, args, out = Service(spark, sf_dir), {"filters": {"field": "lang", "op": "eq", "value": "en"}, "limit": 40}, []
    for page in (1, 2):
        found = service.execute("query", **args)
        out.append((page, found["returned_count"], found["total"], found["truncated"]))
        args["cursor"] = found["next_cursor"]
    return spark.createDataFrame(out, "page int, returned long, total long, truncated boolean")


@query("svc_query_entity", MODEL + "SELECT document_id FROM pages_ WHERE NOT deleted AND document_id IN (SELECT document_id FROM resolved_ WHERE entity_id IN ('entity:company:4', 'entity:security:5')) AND document_id NOT IN (SELECT document_id FROM resolved_ WHERE entity_id = 'entity:company:7') ORDER BY published_at DESC NULLS LAST, document_id LIMIT 100")
def query_entity(spark, sf_dir):
    """A filter on entities, which the snapshot has frozen."""
    node = {"all": [{"field": "entity_ids", "op": "contains_any", "value": ["entity:company:4", "entity:security:5"]}, {"field": "entity_ids", "op": "contains_none", "value": ["entity:company:7"]}]}
    return _rows(spark, Service(spark, sf_dir).execute("query", filters=node, limit=100, max_response_tokens=32_000)["results"], "document_id string")


@query("svc_query_fields", f"{P} SELECT document_id, CASE WHEN doc_id % 3 = 0 THEN 'source' ELSE 'wiki' END AS page_type, strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') AS ingested_at FROM pages_ WHERE NOT deleted AND lang = 'en' AND doc_id % 5 = 1 AND doc_id % 3 <> 1 AND doc_id % 2 = 1 ORDER BY ingested_at, document_id LIMIT 100")
def query_fields(spark, sf_dir):
    """Fields of the metadata: a derived list, a type, one that no page has, one that is missing for some; sorted by another date."""
    node = {"all": [{"field": "language", "op": "eq", "value": "en"}, {"field": "industries", "op": "exists", "value": True}, {"field": "page_type", "op": "in", "value": ["source", "wiki"]}, {"field": "region", "op": "exists", "value": False}, {"not": {"field": "review_status", "op": "eq", "value": "reviewed"}}]}
    found = Service(spark, sf_dir).execute("query", filters=node, sort="ingested_at", direction="asc", fields=["page_type"], limit=100, max_response_tokens=32_000)
    return _rows(spark, found["results"], "document_id string, page_type string, ingested_at string")


@query("svc_search_hybrid", f"WITH {PAGES}, {BLOCKS}, {retrieval._ONE}, best AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, ordinal) AS n FROM f) SELECT document_id, ordinal, channels, round(score, 9) AS score FROM best WHERE n = 1 ORDER BY best.score DESC, document_id LIMIT 20")
def search_hybrid(spark, sf_dir):
    """Passages of a word fused with the nearest vectors of its shortlist, one of each document."""
    from ..views import table

    vector = [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]
    found = Service(spark, sf_dir).execute("search", query="with", mode="hybrid", query_vector=vector, filters={"field": "lang", "op": "eq", "value": "en"}, max_response_tokens=32_000)
    rows = [r | {"score": round(r["score"], 9)} for r in found["results"]]
    return _rows(spark, rows, "document_id string, ordinal int, channels string, score double")


@query("svc_search_entity", MODEL + "SELECT document_id, 'confirmed_membership' AS identity_status FROM pages_ WHERE NOT deleted AND lang = 'en' AND document_id IN (SELECT document_id FROM resolved_ WHERE entity_id = 'entity:company:4') AND len(flatten(list_transform(range(CAST(ceil(length(text) / 1800.0) AS BIGINT)), lambda k: list_filter(regexp_extract_all(lower(substr(text, CAST(1800 * k + 1 AS BIGINT), 1800)), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: x = 'the')))) > 0")
def search_entity(spark, sf_dir):
    """A search about a company: what is asked within its documents, all of them, however many the company has."""
    return Service(spark, sf_dir).matching(query="the", entity_name="Supplier#000000004", entity_type="company", filters={"field": "lang", "op": "eq", "value": "en"})


@query("svc_related_direction", f"{P}, e AS (SELECT a.document_id AS source, b.document_id AS target FROM pages_ a JOIN pages_ b ON b.slug = a.supported_by WHERE NOT a.deleted AND NOT b.deleted), o AS (SELECT * FROM e WHERE source = 'doc:162'), i AS (SELECT * FROM e WHERE target = 'doc:2') SELECT 'outgoing' AS direction, * FROM (SELECT * FROM o UNION SELECT e.* FROM e JOIN o ON e.source = o.target) UNION ALL SELECT 'incoming', * FROM (SELECT * FROM i UNION SELECT e.* FROM e JOIN i ON e.target = i.source)")
def related_direction(spark, sf_dir):
    """Direction holds on every hop."""
    service, out = Service(spark, sf_dir), []
    for direction, start in (("outgoing", "doc:162"), ("incoming", "doc:2")):
        out += [r | {"direction": direction} for r in service.execute("related", id=start, direction=direction, depth=2, limit=100, max_edges=1000, max_nodes=400, max_response_tokens=32_000)["results"]]
    return _rows(spark, out, "direction string, source string, target string")


_ISSUED = f"""WITH {ENTITIES}, issued_ AS (SELECT entity_id AS source, issuer_id AS target, CASE WHEN k % 4 <> 0 THEN DATE '2024-01-01' END AS valid_from, CASE WHEN k % 4 <> 0 AND k % 5 = 0 THEN DATE '2024-06-30' END AS valid_to,
  CASE WHEN k % 3 = 0 THEN DATE '2025-01-01' ELSE DATE '2023-01-01' END AS observed_at FROM (SELECT *, CAST(code AS INTEGER) AS k FROM entities_ WHERE issuer_id IS NOT NULL)) """


@query("svc_graph_as_of", _ISSUED + "SELECT CAST(day AS VARCHAR) AS day, source, target FROM issued_, (SELECT unnest([DATE '1900-01-01', DATE '2024-03-01', DATE '2025-06-01']) AS day) WHERE target IN ('entity:company:3', 'entity:company:4', 'entity:company:5', 'entity:company:7') AND valid_from <= day AND (valid_to IS NULL OR valid_to >= day) AND observed_at <= day UNION ALL SELECT 'any', source, target FROM issued_ WHERE target IN ('entity:company:3', 'entity:company:4', 'entity:company:5', 'entity:company:7')")
def graph_as_of(spark, sf_dir):
    """Business relations of companies on several days: begun, not ended, observed by then; without a day, all."""
    service, out = Service(spark, sf_dir), []
    for day in ("1900-01-01", "2024-03-01", "2025-06-01", None):
        for k in (3, 4, 5, 7):
            args = {"relation_as_of": day} if day else {}
            found = service.execute("graph", operation="neighbors", seed={"kind": "entity", "id": f"entity:company:{k}"}, relation_types=["issued_by"], direction="incoming", **args)
            out += [r | {"day": day or "any"} for r in found["results"]]
    return _rows(spark, out, "day string, source string, target string")


@query("svc_read_metadata_all", f"{P} SELECT (SELECT count(*) FROM pages_ WHERE NOT deleted) AS documents, true AS complete, true AS current_revision, (SELECT CAST(ceil(length(text) / 1800.0) AS BIGINT) FROM pages_ WHERE document_id = 'doc:4') AS total_blocks")
def read_coverage(spark, sf_dir):
    """What the envelope says of the corpus and the revision that is read."""
    found = Service(spark, sf_dir).execute("read", id="doc:4", view="blocks", limit=1, max_response_tokens=32_000)
    return spark.createDataFrame([(found["coverage"]["documents"], found["coverage"]["complete"], found["current_revision"], found["total_blocks"])], "documents long, complete boolean, current_revision boolean, total_blocks long")


_REFUSED = [
    ("operation", "drop", {}, "UNKNOWN_OPERATION"),
    ("argument", "query", {"none": 1}, "INVALID_ARGUMENT"),
    ("sort", "query", {"sort": "text"}, "INVALID_ARGUMENT"),
    ("id", "read", {"id": "doc:none"}, "NOT_FOUND"),
    ("no id", "read", {}, "INVALID_ARGUMENT"),
    ("view", "read", {"id": "doc:4", "view": "nonsense"}, "INVALID_ARGUMENT"),
    ("seed", "graph", {"operation": "neighbors", "seed": {"kind": "entity", "id": "x"}}, "SEED_NOT_FOUND"),
    ("no seed", "graph", {"operation": "neighbors"}, "INVALID_ARGUMENT"),
    ("limit", "query", {"limit": 101}, "INVALID_ARGUMENT"),
    ("block", "read", {"id": "doc:4", "view": "blocks", "block_id": "none"}, "BLOCK_NOT_FOUND"),
    ("revision", "read", {"id": "doc:4", "revision_id": "old"}, "REVISION_UNAVAILABLE"),
    ("cursor", "search", {"query": "the", "cursor": "zzz"}, "INVALID_CURSOR"),
    ("mode", "search", {"query": "the", "mode": "magic"}, "INVALID_ARGUMENT"),
    ("entity type", "search", {"query": "the", "entity_type": "company"}, "INVALID_ARGUMENT"),
    ("direction", "related", {"id": "doc:4", "direction": "sideways"}, "INVALID_ARGUMENT"),
    ("relation types", "graph", {"relation_types": ["likes"]}, "INVALID_ARGUMENT"),
    ("as of", "graph", {"relation_as_of": "2024-02-30"}, "INVALID_ARGUMENT"),
    ("filter", "query", {"filters": {"field": "nothing", "op": "eq", "value": "x"}}, "unknown field or operation"),
]


@query("svc_errors", f"SELECT unnest({[n for n, *_ in _REFUSED]}) AS name, unnest({[c for *_, c in _REFUSED]}) AS code, (SELECT count(*) FROM documents WHERE doc_id = 4) AS documents")
def errors(spark, sf_dir):
    """Codes of refused requests over the corpus."""
    service, out = Service(spark, sf_dir), []
    n = service.docs_of("doc:4").count()
    for name, operation, args, _ in _REFUSED:
        try:
            service.execute(operation, **args)
            out.append((name, "ok", n))
        except InvalidArgument as problem:
            out.append((name, str(problem).split(":")[0], n))
    return spark.createDataFrame(out, "name string, code string, documents long")
