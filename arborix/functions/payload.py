"""Finding JSON payloads in free text and in wrapped answers, and checking judgments. Row-wise Python, for the small documents of an evaluation."""

from __future__ import annotations

import json
import re

_DECODER = json.JSONDecoder()

# Keys of an envelope, in the order in which they are opened.
ENVELOPE = ("structured_output", "result", "content", "output", "message", "final", "final_message")
# What a judgment must have, the measures of its scores, and the levels of its confidence.
REQUIRED = (
    "best_matches_pr",
    "best_overall",
    "overall_ranking",
    "confidence",
    "scores",
    "differences_vs_pr",
    "implementation_differences",
    "notable_strengths",
    "notable_risks",
    "summary",
)
MEASURES = ("pr_alignment", "reuse_alignment", "duplication_risk", "test_alignment")
CONFIDENCE = ("low", "medium", "high")


def first_json(text: str | None):
    """The first JSON object or array in a text, or None."""
    for m in re.finditer(r"[{\[]", text or ""):
        try:
            return _DECODER.raw_decode(text, m.start())[0]
        except ValueError:
            pass
    return None


def is_judgment(value) -> bool:
    """Whether it has scores and both winners, under the newer names or the older ones."""
    return isinstance(value, dict) and "scores" in value and any(f"{w}_matches_pr" in value and f"{w}_overall" in value for w in ("best", "better"))


def is_selection(value) -> bool:
    return isinstance(value, dict) and "summary" in value and "candidates" in value


def is_wanted(value) -> bool:
    return is_judgment(value) or is_selection(value)


def unwrap(value):
    """The first judgment or selection inside envelopes, message lists and JSON texts; the value itself where there is none.

    A text that is JSON is opened in place of its envelope, whatever is in it; other texts are passed over. Envelopes may be nested to any depth.
    """
    if is_wanted(value):
        return value
    inner = []
    if isinstance(value, list):
        inner = value
    elif isinstance(value, dict):
        for part in (value[k] for k in ENVELOPE if k in value):
            if isinstance(part, str):
                try:
                    return unwrap(json.loads(part))
                except ValueError:
                    continue
            if isinstance(part, dict) and is_wanted(got := unwrap(part)):
                return got
        inner = value["messages"] if isinstance(value.get("messages"), list) else []
    return next((got for got in map(unwrap, inner) if is_wanted(got)), value)


def parse_answer(text: str | None) -> dict:
    """The payload of an answer: the text as JSON, else the first JSON in it, taken out of its envelopes."""
    body = (text or "").strip()
    if not body:
        raise ValueError("the answer is empty")
    try:
        value = json.loads(body)
    except ValueError:
        value = first_json(body)
        if value is None:
            raise ValueError("no JSON in the answer") from None
    value = unwrap(value)
    if not isinstance(value, dict):
        raise ValueError("the answer is no JSON object")
    return value


def normalize_judgment(value: dict, labels: list[str]) -> dict:
    """A judgment under the newer names; one that has them stays as it is."""
    if "best_matches_pr" in value:
        return value
    older = {"best_matches_pr": value["better_matches_pr"], "best_overall": value["better_overall"], "implementation_differences": value.get("A_vs_B_differences", [])}
    return {**value, **older, "differences_vs_pr": {x: value.get(f"{x}_vs_pr_differences", []) for x in labels}}


def _texts(value) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


def judgment_errors(value: dict, labels: list[str] | None = None) -> list[str]:
    """Everything that is wrong with a judgment over ``labels`` (A and B unless told otherwise), in the order of its fields; empty for a valid one."""
    labels = labels or ["A", "B"]
    value = normalize_judgment(value, labels) if "best_matches_pr" in value or ("better_matches_pr" in value and "better_overall" in value) else value
    lacking = [k for k in REQUIRED if k not in value]
    if lacking:
        return [f"missing {k}" for k in lacking]
    out = [f"{k} is no label or tie" for k in ("best_matches_pr", "best_overall") if value[k] not in [*labels, "tie"]]
    ranking = value["overall_ranking"]
    if not isinstance(ranking, list) or sorted(map(str, ranking)) != sorted([*labels, "accepted_pr"]):
        out.append("overall_ranking is not each label and accepted_pr once")
    if value["confidence"] not in CONFIDENCE:
        out.append("confidence is not low, medium or high")
    scores = value["scores"] if isinstance(value["scores"], dict) else {}
    for x in labels:
        if not isinstance(scores.get(x), dict):
            out.append(f"scores has no {x}")
            continue
        out += [f"{x}.{m} is not from 1 to 5" for m in MEASURES if not isinstance(scores[x].get(m), int) or not 1 <= scores[x][m] <= 5]
    for k in ("differences_vs_pr", "notable_strengths", "notable_risks"):
        part = value[k]
        out += [f"{k}.{x} is no list of texts" for x in labels if not _texts(part.get(x))] if isinstance(part, dict) else [f"{k} is no object"]
    if not _texts(value["implementation_differences"]):
        out.append("implementation_differences is no list of texts")
    if not isinstance(value["summary"], str):
        out.append("summary is no text")
    return out


def ranking(judgment: dict) -> list[str]:
    """The given ranking if it has the accepted change; else that change first, then the better variant, then the others by label."""
    given = judgment.get("overall_ranking")
    if isinstance(given, list) and "accepted_pr" in given:
        return given
    labels = sorted(set(judgment.get("scores", {})) - {"accepted_pr"})
    best = judgment.get("best_overall") or judgment.get("better_overall")
    return ["accepted_pr", *sorted(labels, key=lambda x: (x != best, x))]
