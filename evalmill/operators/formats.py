"""The files' formats as declared shapes: scenarios, responses, chat examples and run results."""

from __future__ import annotations

from evalmill.functions.shapes import Anything, Keyed, Listed, Maybe, Obj, OneOf, Text, Time

#: Fixed values of the scenario format.
CATEGORIES = ("calendar", "notion", "gmail", "clipboard", "multi_tool")
DIFFICULTIES = ("explicit", "implicit", "contextual", "ambiguous", "multi_step")
BEHAVIORS = ("tool_call", "tool_calls", "clarification", "refusal")
ROLES = ("system", "user", "assistant")
TOOL_NAME = r"[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*"

TOOL = Text(pattern=TOOL_NAME)
SOME_TEXT = Text(least=1)
WORDS = Listed(SOME_TEXT, least=1, unique=True)
BEHAVIOR = OneOf("type", {
    "tool_call": Obj({"type": Text(), "tool": TOOL, "arguments": Keyed()}),
    "tool_calls": Obj({"type": Text(), "calls": Listed(Obj({"tool": TOOL, "arguments": Keyed()}), least=2)}),
    "clarification": Obj({"type": Text(), "question_contains": WORDS}),
    "refusal": Obj({"type": Text(), "reason_contains": WORDS}),
})
SCENARIO = Obj({
    "id": Text(pattern=r"[a-z][a-z0-9_]*_[0-9]{3}"), "category": Text(one_of=CATEGORIES), "difficulty": Text(one_of=DIFFICULTIES),
    "description": SOME_TEXT, "user_input": SOME_TEXT, "current_time": Time(), "available_tools": Listed(TOOL, least=1, unique=True), "initial_state": Keyed(),
    "expected_behavior": BEHAVIOR, "success_criteria": WORDS, "tags": Listed(SOME_TEXT, unique=True),
}, optional=("tags",))
RESPONSE = Obj(
    {"tool_calls": Listed(Obj({"tool": TOOL, "arguments": Keyed()}, optional=("arguments",))), "message": Maybe(Text())},
    optional=("tool_calls", "message")
)
RESPONSES = Keyed(RESPONSE)
EXAMPLE = Obj({"messages": Listed(Obj({"role": Text(one_of=ROLES), "content": Text()}))})
#: Of a run's results only what is asked for is read, so runs may differ in all else.
PAYLOAD = Obj(
    {"run_id": Text(), "backend_name": Maybe(Text()), "scenario_results": Listed(Keyed(Anything()))}, optional=("backend_name",),
    closed=False
)
