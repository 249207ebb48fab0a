"""Rules that settings, prompts, seeds, waves and exports follow on the driver."""

import pytest

from parlance.operators import seeds
from parlance.plans import config, export, state
from parlance.sources import files, stages


def outcome(call):
    """What a call gives, as text; of an error its kind."""
    try:
        return str(call())
    except Exception as error:
        return type(error).__name__


LLM = {"llm": {"agents": {"user": {"model": "m", "temperature": "0.5", "max_tokens": "x"}}}}
ENV = {"LLM_QA_GENERATOR_API_KEY_ENV": "KEY", "KEY": "k", "LLM_USER_MODEL": "e", "N_TURNS": "4", "SEED_TOPICS_ENABLED": "no", "KB_CHUNK_SIZE": "900"}
RULES = [
    ("seeding off", "False", lambda: config.seeding_settings({"run": {"data": {"seeding": {"topics": {"enabled": "false"}}}}}).enabled),
    ("variant case", "msa", lambda: seeds.resolve_variant({"msa"}, explicit="MSA")),
    ("variant language case", "msa", lambda: seeds.resolve_variant({"msa"}, language="AR")),
    ("turns exact", "Turns(least=4, most=4, distribution='poisson', mean=None)", lambda: config.run_settings({"run": {"turns": {"exact": 4}}}).turns),
    ("turns range", "Turns(least=2, most=5, distribution='exponential', mean=None)", lambda: config.run_settings({"run": {"turns": {"mode": "range", "min": 2, "max": 5, "distribution": "exp"}}}).turns),
    ("turns both", "ValueError", lambda: config.run_settings({"run": {"turns": {"exact": 4, "min": 2}}})),
    ("turns crossed", "ValueError", lambda: config.run_settings({"run": {"turns": {"min": 5, "max": 2}}})),
    ("unknown key", "ValueError", lambda: config.run_settings({"runs": {}})),
    ("unknown run key", "ValueError", lambda: config.run_settings({"run": {"turn": 1}})),
    ("languages", "('en', 'fr')", lambda: config.run_settings({"run": {"languages": " en, fr,en,"}}).languages),
    ("no languages", "('en',)", lambda: config.run_settings({"run": {"languages": []}}).languages),
    ("retrieval", "ValueError", lambda: config.run_settings({"retrieval": {"chunk_size": 100, "overlap": 100}})),
    ("judge offline", "False", lambda: config.run_settings({"judge": {"mode": "offline"}}).judged),
    ("judge disabled", "False", lambda: config.run_settings({"judge": {"enabled": False}}).judged),
    ("granularity", "conversation", lambda: config.run_settings({"judge": {"granularity": "Per_Conversation"}}).granularity),
    ("granularity odd", "turn", lambda: config.granularity("odd")),
    ("seeding", "Seeding(question='q', path='data/seeds/topics.yaml', variant='', probability=0.35, enabled=True)", lambda: config.seeding_settings({"run": {"seed_question": "q", "data": {"seeding": {"topics": {"probability": "x"}}}}})),
    ("seeding twice", "ValueError", lambda: config.seeding_settings({"run": {"seed_question": "q", "question_seed": "r"}})),
    ("web search", "WebSearch(enabled=True, num_results=5, timeout=9)", lambda: config.web_search_settings({"tools": {"web_search": {"enabled": "Yes", "num_results": "x", "timeout": "9"}}})),
    ("llm model", "e", lambda: config.llm_settings(LLM, "user", ENV)["model"]),
    ("llm temperature", "0.5", lambda: config.llm_settings(LLM, "user", ENV)["temperature"]),
    ("llm tokens", "None", lambda: config.llm_settings(LLM, "user", ENV)["max_tokens"]),
    ("llm key", "k", lambda: config.llm_settings(LLM, "user", ENV)["api_key"]),
    ("llm no key", "RuntimeError", lambda: config.llm_settings(LLM, "judge", ENV)),
    ("llm global", "ValueError", lambda: config.llm_settings({"llm": {"model": "m"}}, "user", ENV)),
    ("llm credential", "ValueError", lambda: config.llm_settings({"llm": {"agents": {"judge": {"api_key": "k"}}}}, "user", ENV)),
    ("env turns", "4", lambda: config.env_overrides({"run": {"turns": {"exact": 2}}}, ENV)["run"]["turns"]["exact"]),
    ("env flag", "False", lambda: config.env_overrides({}, ENV)["run"]["data"]["seeding"]["topics"]["enabled"]),
    ("env chunk", "900", lambda: config.env_overrides({"retrieval": {"overlap": 1}}, ENV)["retrieval"]["chunk_size"]),
    ("env judge", "{'tools': {'web_search': {'num_results': 7}}, 'judge': {'enabled': False}}", lambda: config.env_overrides({}, {"JUDGE_ENABLED": "off", "SERPER_NUM_RESULTS": "7"})),
    ("env odd", "ValueError", lambda: config.env_overrides({}, {"BATCH_SIZE": "many"})),
    ("personas", "True", lambda: config.personas_enabled({})),
    ("personas off", "False", lambda: config.personas_enabled({"personas": {"enabled": False}})),
    ("merge", "{'a': {'b': 1, 'c': 3}, 'd': 4}", lambda: config.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}, "d": 4})),
    ("secrets", "{'A_TOKEN': 't', 'KEY': 'k'}", lambda: config.load_secrets("export A_TOKEN='t'\nPLAIN=x\n# B_KEY=1\nKEY=k\nHAD_SECRET=new", {"HAD_SECRET": "old"})),
    ("template", "a {{ b }} ", lambda: config.render_template("{{ x }} {{ y }}", {"x": "a {{ b }}"})),
    ("system prompt", "Role:\nr\n\nBackstory:\nb", lambda: config.system_prompt(" r ", " ", "b")),
    ("task prompt", "do 1\n\nExpected output format:\nj", lambda: config.task_prompt("do {{n}}", "j", {"n": 1})),
    ("variant explicit", "gulf", lambda: seeds.resolve_variant({"gulf", "english"}, explicit="gulf")),
    ("variant alias", "msa", lambda: seeds.resolve_variant({"msa"}, explicit="ar", aliases={"ar": "msa"})),
    ("variant default", "france", lambda: seeds.resolve_variant({"france", "english"}, language="fr")),
    ("variant none", "", lambda: seeds.resolve_variant({"x"})),
    ("topic first", "True", lambda: seeds.is_topic_first({"t": {"english": ["q"]}})),
    ("topic second", "False", lambda: seeds.is_topic_first({"english": {"t": ["q"]}})),
    ("waves", "[('en', 0, 2), ('en', 1, 1), ('fr', 0, 1)]", lambda: _waves()),
    ("waves empty", "ValueError", lambda: _waves(0)),
    ("resume", "('r1', True)", lambda: state.run_id_of("r1", "x", {"r1"})),
    ("resume unknown", "('x', False)", lambda: state.run_id_of("r2", "x", {"r1"})),
    ("resume size", "ValueError", lambda: state.check_resume(3, 4)),
    ("resume none", "ValueError", lambda: state.check_resume(None, 4)),
    ("judged file", "judged", lambda: export.effective_source("plain", "judged", 2, "plain")),
    ("gutter", "(140, 164, 360)", lambda: (export.gutter([]), export.gutter(["x" * 20]), export.gutter(["x" * 99]))),
    ("chart", "True", lambda: "&lt;a&gt;" in export.bar_chart("t", [("<a>", 1.0)])),
    ("card", "True", lambda: "path: train" in export.card("me/set", "train", [("records", "", 1.0)]) and "# set" in export.card("me/set", "train", [])),
    ("mapping", "{}", lambda: files.load_mapping("/nowhere.yaml")),
]


def _waves(batch: int = 2):
    from parlance.operators.sampling import plan_waves

    return plan_waves(3, batch, ["en", "fr"], {"fr": 2})


@pytest.mark.parametrize("name, want, call", RULES, ids=[r[0] for r in RULES])
def test_rule(name, want, call):
    assert outcome(call) == want


def test_topics_may_be_the_key_of_variants():
    payload = {"version": 1, "topics": {"english": {"t": ["q"]}, "MSA ": {"t": [" r "]}}, "aliases": {"Arabic": "MSA"}, "defaults": {"by_target_language": {"FR": "msa"}, "final_fallback": "MSA"}}
    assert seeds.seed_rows(payload) == [("english", "t", 0, "q", 0), ("msa", "t", 0, "r", 0)]
    choose = lambda **x: seeds.chosen_variant(payload, **x)
    assert (choose(language="fr"), choose(explicit="arabic"), choose(explicit="gulf"), choose(language="en")) == ("msa", "msa", "msa", "english")


@pytest.mark.parametrize(
    "content, text",
    [
        (None, ""), ("t", "t"), ([{"text": "a"}, "b", {"image": 1}, {"content": "c"}, None], "abc"), ({"text": "m"}, "m"), ({"z": 1}, '{"z": 1}'), (3, "3"),
        ({"text": None, "content": "x"}, "x"), ([{"text": 5}], "5"), ({"content": 4}, '{"content": 4}'), ([], ""), ({}, "{}"),
    ],
)
def test_content_of_any_shape(content, text):
    assert stages.content_text(content) == text


@pytest.mark.parametrize(
    "calls, told",
    [
        (None, []), ({"id": 5, "function": {"name": "f", "arguments": {"a": 1}}}, [("5", "f", '{"a": 1}')]), ([{"function": {"name": "g"}}, {"id": "x", "function": {"arguments": None}}], [("", "g", "{}"), ("x", "", "{}")]), ([{"id": "y"}, 7], [("y", "", "{}"), ("", "", "{}")]),
    ],
)
def test_calls_of_any_shape(calls, told):
    assert [(c["id"], c["name"], c["arguments"]) for c in stages.tool_calls(calls)] == told


def test_flags_are_no_scores():
    assert stages._verdict({"score": True})["score"] is None and stages._verdict({"score": 3})["score"] == 3.0


def test_an_endpoint_without_json_mode_is_found_out_once():
    asked = []

    def call(request):
        asked.append((request.get("endpoint"), request["response_format"]))
        if request.get("endpoint") == "down" or request.get("endpoint") == "old" and request["response_format"] == "json_object":
            raise ValueError("no")
        return {"content": request["response_format"]}

    ask = stages.with_text_fallback(call)
    wanted = lambda endpoint: ask({"endpoint": endpoint, "response_format": "json_object"})["content"]
    assert wanted("old") == wanted("old") == "text" and wanted("new") == "json_object"
    assert [a for a in asked if a[0] == "old"] == [("old", "json_object"), ("old", "text"), ("old", "json_object"), ("old", "text")]
    with pytest.raises(ValueError):
        wanted("down")
    assert ask({"endpoint": "old", "response_format": "text"})["content"] == "text"


def test_a_passing_error_does_not_turn_json_mode_off():
    errors = [ValueError("timed out")]

    def call(request):
        if request["response_format"] == "json_object" and errors:
            raise errors.pop()
        return {"content": request["response_format"]}

    ask = stages.with_text_fallback(call)
    assert [ask({"response_format": "json_object"})["content"] for _ in range(2)] == ["json_object"] * 2
