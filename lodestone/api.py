"""The tools over a store: queries, dependencies, cross references, resources; and the texts they answer with.

Only this module collects, and only short results. A model is a callable (system, prompt) -> text, named in a registry;
without one the answers are the raw results.
"""

from __future__ import annotations

import json
import logging
import math
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import errors, schemas
from .operators import graph, search
from .operators.embeddings import Provider
from .plans import analysis, fusion, hybrid, models
from .sources.store import Store

log = logging.getLogger("lodestone")

# Words that call for the larger model.
COMPLEX_WORDS = ["architecture", "refactor", "design", "integrate", "how do i", "best way", "should i"]
NONE, LOCAL, ESCALATED = "none", "local", "escalated"
#: Rows that a tool shows of each kind; the totals it names are counted over all.
SHOWN = 50
_models: dict[str, Callable[..., analysis.Model]] = {"openai": models.openai, "llamacpp": models.llamacpp}


def configure_logging(path: str | None = None) -> None:
    """Lines to the console and, if a path is given, to the end of a file; the level comes from LOG_LEVEL."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        handlers.append(logging.FileHandler(path))
    logging.basicConfig(
        level=os.environ.get("LOG_LEVEL", "INFO").upper(),
        format="%(asctime)s %(levelname)s %(message)s",
        handlers=handlers,
        force=True,
    )


def register_model(name: str, factory: Callable[..., analysis.Model]) -> None:
    _models[name] = factory


def create_model(name: str | None = None) -> analysis.Model | None:
    """The model that is named here or in AI_PROVIDER; none if neither is."""
    name = name or os.environ.get("AI_PROVIDER")
    if not name:
        return None
    if name not in _models:
        raise errors.ConfigurationError(f"no model is registered as {name!r}", context={"key": "AI_PROVIDER"})
    return _models[name]()


@dataclass
class Config:
    default_attendant: str = LOCAL
    auto_escalate: bool = True
    max_tokens: int = 500
    max_results: int = 20


@dataclass
class Combined:
    """Heads of the searches' results, collected, and how many results each has in all."""

    semantic: list[dict] = field(default_factory=list)
    graph: list[dict] = field(default_factory=list)
    cross_refs: list[dict] = field(default_factory=list)
    totals: dict[str, int] = field(default_factory=dict)

    def total(self, kind: str) -> int:
        return self.totals.get(kind, len(getattr(self, kind)))

    def tokens(self) -> int:
        """Four characters a token over contents, metadata, ids, properties and references."""
        n = sum(len(r.get("content") or "") + len(r.get("metadata") or "{}") for r in self.semantic)
        n += sum(len(r["id"]) + len(r.get("properties") or "{}") for r in self.graph)
        n += sum(
            len(r[k] or "") for r in self.cross_refs for k in (
                "from_repo", "from_entity", "to_repo", "to_entity", "type"
            )
        )
        return math.ceil(n / 4)

    def repositories(self) -> list[str]:
        names = [r.get("repo") for r in [*self.semantic, *self.graph]] + [
            r[k] for r in self.cross_refs for k in ("from_repo", "to_repo")
        ]
        return list(dict.fromkeys(x for x in names if x))


def tokens(text: str) -> int:
    return max(1, math.ceil(len(text) / 4))


@dataclass
class Answer:
    answer: str
    repositories: list[str]
    original_tokens: int
    filtered_tokens: int

    @property
    def reduction_percent(self) -> int:
        return round(
            (self.original_tokens - self.filtered_tokens) / self.original_tokens * 100
        ) if self.original_tokens else 0


def _reference(r: dict) -> str:
    return f"{r['from_repo']}/{r['from_entity']} → {r['to_repo']}/{r['to_entity']}"


def _section(title: str, total: int, lines: list[str]) -> str:
    """A list under a heading that says how many there are, and how many of them are shown."""
    if not lines:
        return f"## {title}: none"
    return f"## {title}: {total}" + (f", the first {len(lines)}" if total > len(lines) else "") + "\n" + "\n".join(lines)


class Attendant:
    """Shortens results by a model; without one, or when it fails, by taking their heads."""

    def __init__(self, model: analysis.Model | None = None):
        self.model = model

    def sections(self, found: Combined) -> list[str]:
        """What a model reads of the results: at most ten, ten and five of them."""
        out = []
        texts = [f"{i}. [{r['repo']}] {r['content'][:200]}{'...' if len(r['content']) > 200 else ''} (similarity {r.get('similarity', 0) or 0:.2f})" for i, r in enumerate(found.semantic[:10], 1)]
        out.append(_section("Texts", found.total("semantic"), texts))
        nodes = []
        for i, r in enumerate(found.graph[:10], 1):
            try:
                props = json.loads(r.get("properties") or "{}")
            except ValueError:
                props = {}
            known = "; ".join(f"{k} = {v}" for k, v in list(props.items())[:3])
            edge = f", {r['relationship']} with weight {r['weight']}" if r.get("relationship") else ""
            nodes.append(f"{i}. [{r['repo']}] {r['id']}{edge}{f' ({known})' if known else ''}")
        out.append(_section("Entities", found.total("graph"), nodes))
        refs = [f"{i}. {_reference(r)}: {r['type']}, strength {r['strength']:.2f}" for i, r in enumerate(found.cross_refs[:5], 1)]
        out.append(_section("References between repositories", found.total("cross_refs"), refs))
        return out

    def raw(self, query: str, found: Combined) -> str:
        parts = [f"# {query}"]
        if found.semantic:
            parts.append(
                _section(
                    "Texts",
                    found.total("semantic"),
                    [f"- [{r['repo']}] {r['content'][:150]}" for r in found.semantic[:5]],
                )
            )
        if found.graph:
            parts.append(
                _section("Entities", found.total("graph"), [f"- [{r['repo']}] {r['id']}" for r in found.graph[:5]])
            )
        if found.cross_refs:
            parts.append(
                _section(
                    "References between repositories",
                    found.total("cross_refs"),
                    [f"- {_reference(r)}: {r['type']}" for r in found.cross_refs[:3]],
                )
            )
        return "\n\n".join(parts)

    def filter(self, query: str, found: Combined, max_tokens: int = 500, context: str | None = None) -> Answer:
        answer = None
        if self.model:
            prompt = "\n\n".join(
                [
                    f"Question: {query}",
                    *([f"Context: {context}"] if context else []),
                    *self.sections(found),
                    f"Answer in at most {max_tokens} tokens, naming repositories.",
                ]
            )
            try:
                answer = self.model("You pick what matters from search results.", prompt)
            except Exception:
                log.exception("the model failed; results are shown as they are")
        answer = answer or self.raw(query, found)
        return Answer(answer, found.repositories(), found.tokens(), tokens(answer))


def select_attendant(query: str, repositories: list[str], n_tokens: int, config: Config, has_escalation: bool) -> str:
    """Which model a question goes to."""
    if not config.auto_escalate:
        return config.default_attendant
    if has_escalation and (len(repositories) > 3 or n_tokens > 5000 or any(w in query.lower() for w in COMPLEX_WORDS)):
        return ESCALATED
    return LOCAL


def render_hybrid(
    query: str,
    rows: list[dict],
    found: analysis.Analysis,
    coverage: dict[str, float],
    seconds: dict[str, float],
    refs: Combined,
) -> str:
    weights = ", ".join(f"{s} {found.weights[s]:g}" for s in fusion.SOURCES)
    shares = ", ".join(f"{s} {coverage[s]:.0%}" for s in fusion.SOURCES)
    took = ", ".join(f"{k} {v * 1000:.0f} ms" for k, v in seconds.items())
    out = [f"# {query}", f"Taken as a {found.query_type} query (confidence {found.confidence or 0:.2f}): {found.reasoning}.\nWeights: {weights}. Share of results by search: {shares}. Time: {took}."]
    shown = []
    for r in rows[:10]:
        known = ", ".join(f"{s} #{r[s]}" for s in fusion.SOURCES if r[s] is not None)
        why = f"\n   {r['explanation']}".replace("\n", "\n   ") if r.get("explanation") else ""
        shown.append(
            f"{r['rank']}. [{r['repo']}] score {r['score']:.4f}, {known}\n   {(r['content'] or '')[:300]}{why}"
        )
    out.append(_section("Results", len(rows), shown))
    if refs.cross_refs:
        out.append(
            _section(
                "References between repositories",
                refs.total("cross_refs"),
                [f"- {_reference(r)}: {r['type']}, strength {r['strength']:.2f}" for r in refs.cross_refs[:10]],
            )
        )
    return "\n\n".join(out)


def render_raw(query: str, found: Combined) -> str:
    out = [f"# {query}"]
    if found.semantic:
        out.append(
            _section(
                "Texts",
                found.total("semantic"),
                [
                    f"- [{r['repo']}] (similarity {r.get('similarity', 0) or 0:.2f}) {r['content'][:300]}" for r in found.semantic[:10]
                ],
            )
        )
    if found.graph:
        out.append(
            _section(
                "Entities",
                found.total("graph"),
                [f"- [{r['repo']}] {r['id']} {r.get('properties') or '{}'}" for r in found.graph[:10]],
            )
        )
    if found.cross_refs:
        out.append(
            _section(
                "References between repositories",
                found.total("cross_refs"),
                [f"- {_reference(r)}: {r['type']}, strength {r['strength']:.2f}" for r in found.cross_refs[:10]],
            )
        )
    if len(out) == 1:
        out.append(
            "Nothing found. list_repositories names what is indexed; another word or another repository may help."
        )
    return "\n\n".join(out)


class Engine:
    """The tools."""

    def __init__(
        self,
        store: Store,
        *,
        provider: Provider | None = None,
        model: analysis.Model | None = None,
        local_model: analysis.Model | None = None,
        escalation_model: analysis.Model | None = None,
        config: Config | None = None,
    ):
        self.store, self.config = store, config or Config()
        self.attendants = {LOCAL: Attendant(local_model), ESCALATED: Attendant(escalation_model or local_model)}
        self.has_escalation = escalation_model is not None
        # the store's inverted index, so that a search reads the postings of its terms and not all texts
        index = (store.postings(), store.posting_stats()) if store.has("postings") else (None, None)
        tables = hybrid.Tables(
            store.chunks(),
            store.nodes(),
            store.edges(),
            store.table("embeddings"),
            store.table("cross_references"),
            *index,
        )
        self.tables, self.search = tables, hybrid.HybridSearch(tables, provider, model)

    def _rows(self, df: DataFrame, n: int = SHOWN) -> list[dict]:
        return [r.asDict() for r in df.limit(n).collect()]

    def _counted(self, df: DataFrame, *order: Column | str) -> tuple[list[dict], int]:
        """The first rows, and how many there are."""
        rows = self._rows(df.orderBy(*order))
        return rows, len(rows) if len(rows) < SHOWN else df.count()

    def query_repositories(
        self,
        query: str,
        *,
        repositories: list[str] | None = None,
        attendant: str | None = None,
        max_tokens: int | None = None,
        context: str | None = None,
    ) -> str:
        """Hybrid search, references between the repositories it finds, and an answer."""
        began = time.perf_counter()
        result = self.search.search(query, repositories=repositories, max_results=self.config.max_results)
        fused = result.explained(self.search.k).orderBy("rank").cache()
        rows = self._rows(fused)
        coverage = fusion.total_coverage(fused).first().asDict()
        semantic = [r for r in rows if r["dense"] is not None]
        spark = self.tables.chunks.sparkSession
        repos = spark.createDataFrame([(r["repo"],) for r in semantic] or [(None,)], "repo string")
        refs, n_refs = self._counted(
            search.cross_references_of(self.tables.cross_references, repos), F.desc("strength"), "id"
        )
        fused.unpersist()
        nodes = [r | {"properties": r["content"]} for r in rows if r["graph"] is not None]
        found = Combined([r for r in rows if r["graph"] is None], nodes, refs, {"cross_refs": n_refs})
        mode = attendant or select_attendant(
            query, found.repositories(), found.tokens(), self.config, self.has_escalation
        )
        if mode == NONE:
            return render_hybrid(query, rows, result.analysis, coverage, {"all": time.perf_counter() - began}, found)
        said = self.attendants[mode].filter(query, found, max_tokens or self.config.max_tokens, context)
        shares = ", ".join(f"{s} {coverage[s] * 100:.0f}%" for s in fusion.SOURCES)
        return f"{said.answer}\n\n---\nCoverage: {shares}\nTokens: {said.original_tokens} → {said.filtered_tokens} ({said.reduction_percent}% less)\nRepositories: {', '.join(said.repositories)}"

    def smart_query(
        self, question: str, *, context: str | None = None, attendant: str | None = None, max_tokens: int | None = None
    ) -> str:
        """Over all repositories, with the model that fits the question."""
        return self.query_repositories(question, attendant=attendant, max_tokens=max_tokens, context=context)

    def list_repositories(self) -> str:
        rows = [r.asDict() for r in self.store.repositories().toLocalIterator()]
        if not rows:
            return "The store has no repositories yet; index_repository() adds one."
        return f"# Repositories: {len(rows)}\n\n" + "\n".join(f"- **{r['id']}** ({r['name']}), version {r['version'] or 'unknown'}, indexed {r['indexed_at']}" for r in rows)

    def query_dependency(
        self, dependency: str, *, repositories: list[str] | None = None, aspect: str = "all", attendant: str = NONE
    ) -> str:
        """An entity and, for 'relationships' and 'all', the neighbours of its first three matches."""
        if aspect not in ("usage", "relationships", "implementation", "all"):
            raise errors.ValidationError(f"unknown aspect: {aspect}", context={"field": "aspect"})
        t = self.tables
        hits = search.entity(
            t.nodes, t.edges, dependency, repositories=repositories
        ).drop("repo").withColumnRenamed("found_repo", "repo")
        rows, total = self._counted(hits, "id", "relationship", "source", "target")
        if aspect in ("relationships", "all"):
            for node in list(dict.fromkeys(r["id"] for r in rows))[:3]:
                near = search.entity_relationships(
                    t.nodes, t.edges, node, repositories=repositories
                ).drop("repo").withColumnRenamed("found_repo", "repo")
                more, n = self._counted(near, "id", "relationship")
                rows, total = rows + more, total + n
        found = Combined(graph=rows, totals={"graph": total})
        return render_raw(
            dependency, found
        ) if attendant == NONE else self.attendants[attendant].filter(dependency, found).answer

    def get_cross_references(self, entity: str, *, source_repo: str | None = None, min_strength: float = 0.7) -> str:
        t = self.tables
        if source_repo is None:
            first = search.entity(t.nodes, t.edges, entity).orderBy("id").limit(1).collect()
            source_repo = first[0]["found_repo"] if first else "unknown"
        strong = t.cross_references.where(F.col("strength") >= min_strength)
        rows, total = self._counted(search.references_to(strong, entity, source_repo), F.desc("strength"), "id")
        found = Combined(cross_refs=rows, totals={"cross_refs": total})
        return render_raw(entity, found) if rows else f"No reference of this strength touches {entity}."

    def ask(self, question: str, model: analysis.Model) -> str:
        """A question to a model that knows the most connected entities."""
        top = [(r["id"], r["degree"]) for r in graph.degree_top(self.tables.nodes, self.tables.edges).collect()]
        return model(
            "Answer from the centrality measures of a knowledge graph.",
            f"{graph.centrality_text(top)}\nQuestion: {question}",
        )

    def resources(self) -> list[dict]:
        return [
            {
                "uri": schemas.resource_uri(r["id"]), "name": r["name"], "mimeType": "application/json"
            } for r in self.store.repositories().toLocalIterator()
        ]

    def read_resource(self, uri: str) -> str:
        prefix = schemas.resource_uri("")
        found = self.store.repository(uri.removeprefix(prefix)) if uri.startswith(prefix) else None
        if found is None:
            raise errors.ToolServerError(f"no such resource: {uri}", context={"uri": uri})
        return json.dumps(found, default=str, indent=2)

    def call(self, tool: str, arguments: dict) -> dict:
        """Run a tool by name; an error becomes a text result, an unknown tool raises."""
        tools = {
            "query_repositories": self.query_repositories,
            "list_repositories": self.list_repositories,
            "query_dependency": self.query_dependency,
            "get_cross_references": self.get_cross_references,
            "smart_query": self.smart_query,
        }
        if tool not in tools:
            raise errors.ToolError(f"unknown tool: {tool}", context={"tool": tool})
        try:
            return {"text": tools[tool](**arguments), "is_error": False}
        except Exception as e:
            log.exception("tool %s failed", tool)
            return {"text": f"Error: {errors.wrap(e, tool)}", "is_error": True}
