"""Settings of a run, checked on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

#: Names of a distribution and what they mean.
DISTRIBUTIONS = {"uniform": "uniform", "poisson": "poisson", "pois": "poisson", "exponential": "exponential", "exp": "exponential"}
GRANULARITIES = {"turn": "turn", "per_turn": "turn", "turns": "turn", "conversation": "conversation", "per_conversation": "conversation", "conv": "conversation", "conversation_level": "conversation"}
#: Keys that belong to an agent, not to all of them; credentials, which only the environment may give; agents' roles and their names in it.
AGENT_ONLY = ("model", "provider", "base_url", "temperature", "max_tokens", "top_p", "timeout", "max_retries")
CREDENTIALS = ("api_key", "api_key_env", "token", "secret")
ROLES = {"user": "QA_GENERATOR", "assistant": "KB_RESPONDER", "judge": "QA_JUDGE"}
#: Settings that the environment overrides: its name, where the setting is, its kind.
OVERRIDES = {
    "N_TURNS": ("run.turns.exact", int),
    "MIN_TURNS": ("run.turns.min", int),
    "MAX_TURNS": ("run.turns.max", int),
    "TURN_COUNT_DISTRIBUTION": ("run.turns.distribution", str),
    "TURN_COUNT_MEAN": ("run.turns.mean", float),
    "BATCH_SIZE": ("run.batch_size", int),
    "TOTAL_SAMPLES": ("run.total_samples", int),
    "RUN_ID": ("run.run_id", str),
    "RESUME_RUN_ID": ("run.resume_run_id", str),
    "QUESTION": ("run.data.seeding.question", str),
    "SEED_TOPICS_PATH": ("run.data.seeding.topics.path", str),
    "SEED_TOPICS_VARIANT": ("run.data.seeding.topics.variant", str),
    "SEED_TOPICS_PROBABILITY": ("run.data.seeding.topics.probability", float),
    "SEED_TOPICS_ENABLED": ("run.data.seeding.topics.enabled", bool),
    "KB_CHUNK_SIZE": ("retrieval.chunk_size", int),
    "KB_CHUNK_OVERLAP": ("retrieval.overlap", int),
    "KB_DEFAULT_K": ("retrieval.top_k", int),
    "KB_PERSIST_DIR": ("store.index.persist_dir", str),
    "KB_REBUILD_INDEX": ("store.index.rebuild", bool),
    "KB_SKIP_IF_UNCHANGED": ("store.index.skip_if_unchanged", bool),
    "KB_EMBEDDING_BACKEND": ("models.embeddings.backend", str),
    "KB_EMBEDDING_DEVICE": ("models.embeddings.device", str),
    "DOC_COVERAGE_MODE": ("coverage.doc_coverage_mode", str),
    "DOC_COVERAGE_EPSILON": ("coverage.doc_coverage_epsilon", float),
    "DOC_COVERAGE_FRACTION": ("coverage.doc_coverage_fraction", float),
    "QUESTION_DEDUP_RETRIES": ("run.dedup_retries", int),
    "ENABLE_WEB_TOOLS": ("tools.web_search.enabled", bool),
    "SERPER_NUM_RESULTS": ("tools.web_search.num_results", int),
    "SERPER_TIMEOUT": ("tools.web_search.timeout", int),
    "JUDGE_MODE": ("judge.mode", str),
    "JUDGE_GRANULARITY": ("judge.granularity", str),
    "JUDGE_ENABLED": ("judge.enabled", bool),
    "OUTPUT_DIR": ("saving.output_dir", str),
    "HF_PUSH_ENABLED": ("saving.export.enabled", bool),
    "HF_PUSH_REPO_ID": ("saving.export.repo_id", str),
    "HF_PUSH_REPO_TYPE": ("saving.export.repo_type", str),
    "HF_PUSH_EXPORT_DIR": ("saving.export.export_dir", str),
    "HF_PUSH_INCLUDE_RUN_STATE": ("saving.export.include_run_state", bool),
    "HF_PUSH_PRIVATE": ("saving.export.private", bool),
    "HF_PUSH_COMMIT_MESSAGE": ("saving.export.commit_message", str),
    "HF_PUSH_SOURCE_FILE": ("saving.export.source_file", str),
    "HF_PUSH_GENERATE_STATS": ("saving.export.generate_stats", bool),
    "HF_PUSH_STATS_FILE": ("saving.export.stats_file", str),
    "HF_PUSH_GENERATE_PLOTS": ("saving.export.generate_plots", bool),
    "HF_PUSH_PLOTS_DIR": ("saving.export.plots_dir", str),
    "QUESTION_SEED": ("run.data.seeding.question", str),
    "LLM_MODE": ("llm.mode", str),
    "LLM_BACKEND": ("llm.mode", str),
}
KNOWN = ("run", "retrieval", "judge", "tools", "llm", "personas", "coverage", "saving", "store", "models")
KNOWN_RUN = ("turns", "languages", "batch_size", "total_samples", "seed", "dedup_retries", "run_id", "resume_run_id", "data", "seed_question", "question_seed", "distributed")
SECRET = re.compile(r"(?:^|_)(?:API_KEY|TOKEN|SECRET|PASSWORD|KEY)$")
TEMPLATE = re.compile(r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}")


@dataclass(frozen=True)
class Turns:
    """How many turns a conversation has: exactly ``least``, or drawn between the bounds."""

    least: int = 1
    most: int = 1
    distribution: str = "poisson"
    mean: float | None = None

    def __post_init__(self):
        if self.distribution not in DISTRIBUTIONS:
            raise ValueError(f"no such distribution: {self.distribution}")
        object.__setattr__(self, "distribution", DISTRIBUTIONS[self.distribution])
        if not 1 <= self.least <= self.most:
            raise ValueError("turns need 1 <= least <= most")


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 4
    chunk_size: int = 750
    overlap: int = 150
    candidates: int = 12

    def __post_init__(self):
        if self.top_k < 1 or not 0 <= self.overlap < self.chunk_size:
            raise ValueError("retrieval needs top_k >= 1 and 0 <= overlap < chunk_size")


@dataclass(frozen=True)
class Run:
    turns: Turns = field(default_factory=Turns)
    retrieval: Retrieval = field(default_factory=Retrieval)
    languages: tuple[str, ...] = ("en",)
    batch_size: int = 1
    total_samples: int = 0
    seed: int = 0
    dedup_retries: int = 3
    judge: str = "online"
    granularity: str = "turn"

    @property
    def judged(self) -> bool:
        return self.judge != "offline"


def run_settings(raw: dict) -> Run:
    """Settings from a nested mapping; unknown keys are an error, and a number of turns excludes bounds."""
    unknown = sorted(set(raw) - set(KNOWN)) + sorted(f"run.{k}" for k in set(raw.get("run") or {}) - set(KNOWN_RUN))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    run, turns = dict(raw.get("run") or {}), dict((raw.get("run") or {}).get("turns") or {})
    exact = turns.pop("exact", None)
    low, high = turns.pop("min", None), turns.pop("max", None)
    mode = turns.pop("mode", "exact" if exact is not None else "range")
    if exact is not None and (low is not None or high is not None):
        raise ValueError("an exact number of turns excludes bounds")
    bounds = (exact or 1, exact or 1) if mode == "exact" else (low if low is not None else 1, high if high is not None else low or 1)
    languages = run.get("languages", ("en",))
    languages = [x.strip() for x in (languages.split(",") if isinstance(languages, str) else languages)]
    kept = {k: run[k] for k in ("batch_size", "total_samples", "seed", "dedup_retries") if k in run}
    retrieval = Retrieval(**(raw.get("retrieval") or {}))
    judge = raw.get("judge") or {}
    return Run(
        Turns(*map(int, bounds), **turns), retrieval, tuple(dict.fromkeys(x for x in languages if x)) or ("en",),
        judge=judge.get("mode", "online") if judge.get("enabled", True) else "offline", granularity=granularity(judge.get("granularity")), **kept,
    )


def granularity(name: str | None, fallback: str = "turn") -> str:
    """What is judged, a turn or a conversation, by any of their names."""
    return GRANULARITIES.get(str(name or fallback).strip().lower(), fallback)


@dataclass(frozen=True)
class Seeding:
    question: str = ""
    path: str = "data/seeds/topics.yaml"
    variant: str = ""
    probability: float = 0.35
    enabled: bool = True


def seeding_settings(raw: dict) -> Seeding:
    """The seeding block; a question may also stand in either of two older places, which must agree."""
    run = raw.get("run") or {}
    block = (run.get("data") or {}).get("seeding") or {}
    topics = block.get("topics") or {}
    older = {q for q in (str(run.get(k) or "").strip() for k in ("seed_question", "question_seed")) if q}
    if len(older) > 1:
        raise ValueError("two different seed questions")
    question = str(block.get("question") or "").strip() or next(iter(older), "")
    try:
        chance = float(topics.get("probability", Seeding.probability))
    except (TypeError, ValueError):
        chance = Seeding.probability
    return Seeding(question, str(topics.get("path") or Seeding.path), str(topics.get("variant") or ""), chance, truthy(topics.get("enabled", True)))


@dataclass(frozen=True)
class WebSearch:
    enabled: bool = False
    num_results: int = 5
    timeout: int = 30


def web_search_settings(raw: dict) -> WebSearch:
    """The tools' web search; what is no number keeps its default, words for true count as true."""
    block = (raw.get("tools") or {}).get("web_search") or {}

    def number(key: str, default: int) -> int:
        try:
            return int(block.get(key, default))
        except (TypeError, ValueError):
            return default

    return WebSearch(truthy(block.get("enabled", False)), number("num_results", 5), number("timeout", 30))


def truthy(value: object) -> bool:
    return str(value).strip().lower() in ("1", "true", "yes", "on")


def check_llm_keys(raw: dict) -> None:
    """Refuses settings of one agent given for all, and credentials anywhere in the file."""
    block = raw.get("llm") or {}
    found = [f"llm.{k}" for k in (*AGENT_ONLY, *CREDENTIALS) if k in block]
    found += [f"llm.agents.{name}.{k}" for name, agent in (block.get("agents") or {}).items() if isinstance(agent, dict) for k in CREDENTIALS if k in agent]
    if found:
        raise ValueError(f"these may not be set here: {', '.join(sorted(found))}")


def llm_settings(raw: dict, role: str, env: dict[str, str] | None = None) -> dict:
    """An agent's settings: the file's, over which the environment's win; its key comes from the variable that the environment names."""
    env = os.environ if env is None else env
    check_llm_keys(raw)
    agent = ((raw.get("llm") or {}).get("agents") or {}).get(role) or {}
    stage = ROLES[role]
    out = {}
    for key in AGENT_ONLY:
        given = next((v for v in (env.get(f"LLM_{name}_{key.upper()}", "").strip() for name in (stage, role.upper())) if v), agent.get(key))
        if key in ("temperature", "top_p", "timeout", "max_tokens", "max_retries"):
            try:
                given = None if given is None else (int if key.startswith("max_") else float)(given)
            except (TypeError, ValueError):
                given = None
        out[key] = given
    named = env.get(f"LLM_{stage}_API_KEY_ENV", "").strip()
    if not named or not env.get(named, "").strip():
        raise RuntimeError(f"no key for {role}: LLM_{stage}_API_KEY_ENV must name a variable that is set")
    return out | {"api_key": env[named]}


def env_overrides(raw: dict, env: dict[str, str] | None = None) -> dict:
    """Settings with those that the environment gives in their place; a value that isn't of its kind is an error."""
    env, out = os.environ if env is None else env, raw
    for name, (path, kind) in OVERRIDES.items():
        if env.get(name, "").strip():
            text = env[name].strip()
            value = truthy(text) if kind is bool else kind(text)
            for key in reversed(path.split(".")):
                value = {key: value}
            out = deep_merge(out, value)
    return out


def personas_enabled(raw: dict) -> bool:
    return bool((raw.get("personas") or {}).get("enabled", True))


def deep_merge(left: dict, right: dict) -> dict:
    """Union of keys at every level; where both have a plain value the right one wins."""
    out = dict(left)
    for key, value in right.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def render_template(template: str, values: dict) -> str:
    """``{{ key }}`` replaced in one pass; a missing or null value is blank."""
    return TEMPLATE.sub(lambda m: "" if values.get(m[1]) is None else str(values[m[1]]), template)


def system_prompt(role: str, goal: str, backstory: str) -> str:
    parts = (("Role", role), ("Goal", goal), ("Backstory", backstory))
    return "\n\n".join(f"{name}:\n{text.strip()}" for name, text in parts if text and text.strip())


def task_prompt(task: str, expected: str, values: dict) -> str:
    """The task, then the expected output's format, both rendered."""
    text = render_template(task, values).strip()
    return f"{text}\n\nExpected output format:\n{render_template(expected, values).strip()}" if expected.strip() else text


def load_secrets(text: str, env: dict[str, str] | None = None) -> dict[str, str]:
    """Secret-like settings of a dotenv text that aren't set yet; returns and sets them."""
    env = os.environ if env is None else env
    found = {}
    for line in text.splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not key.startswith("#") and SECRET.search(key.strip()) and key.strip() not in env:
            found[key.strip()] = value.strip().strip("\"'")
    env.update(found)
    return found
