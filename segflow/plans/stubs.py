"""Deterministic stand-ins for models, for the registered queries and the tests only."""

from __future__ import annotations


def echo_model(requests: list) -> list:
    """Every line in brackets."""
    return [[{"speaker": p["speaker"], "text": f"[{p['text']}]"} for p in r["pairs"]] for r in requests]


def short_chunks_model(requests: list) -> list:
    """Brackets for up to four lines, no answer to more."""
    return [None if len(r["pairs"]) > 4 else answer for r, answer in zip(requests, echo_model(requests), strict=True)]


def part_of(prompt: str, begin: str, end: str) -> str:
    return prompt.split(begin, 1)[1].split(end, 1)[0]


def context_echo_model(requests: list) -> list:
    """Every line with the lengths of the context before and after that its prompt holds; no answer to more than six lines."""
    out = []
    for r in requests:
        before, after = part_of(r["prompt"], "\nBefore:\n", "\nText:\n"), r["prompt"].rsplit("\nAfter:\n", 1)[1]
        out.append(None if len(r["pairs"]) > 6 else [{"speaker": p["speaker"], "text": f"{p['text']}<{len(before)},{len(after)}>"} for p in r["pairs"]])
    return out


def prompt_echo_model(requests: list) -> list:
    """The refiner that answers with the terms and the heading lines of its prompt as short and long forms."""
    terms = [part_of(r["prompt"], "# Terms\n", "\n# About") for r in requests]
    return [[{"speaker": p["speaker"], "text": p["text"], "very_short": "v", "short": t, "long": r["prompt"].split("\n", 1)[0]} for p in r["pairs"]] for r, t in zip(requests, terms, strict=True)]


def variants_model(requests: list) -> list:
    """The refiner: text with very short, short and long forms."""
    return [[{"speaker": p["speaker"], "text": p["text"], "very_short": p["text"][: len(p["text"]) * 45 // 100], "short": p["text"][: len(p["text"]) * 60 // 100], "long": p["text"] + " " + p["text"][: len(p["text"]) // 5]} for p in r["pairs"]] for r in requests]


def adjust_length(texts: list) -> list:
    """The length adjuster: (text, target_chars) cut or repeated to the target."""
    return [None if t is None else (t["text"] * (1 + (t["target_chars"] or 0) // max(1, len(t["text"]))))[: t["target_chars"] or 0] or t["text"] for t in texts]


def moody_adjuster(requests: list) -> list:
    """A length adjuster that by the text's length gives JSON, plain text, broken JSON or nothing; each shows the target that the prompt names."""
    out = []
    for r in requests:
        n = part_of(r["prompt"], "in about ", " characters")
        out.append([{"text": f" {n}/{r['text']} "}, f"{n}:{r['text']}", '{"text": ', None][len(r["text"]) % 4])
    return out


def emotion_model(texts: list) -> list:
    """The emotion classifier: a code by the text's last mark."""
    return [None if t is None else {"!": "hap", "?": "ang", ".": "neu"}.get(t[-1:], "sad") for t in texts]


def voice_model(plans: list) -> list:
    """The voice encoder: a short vector from an excerpt plan's times."""
    return [[p["start_ms"] % 97 / 97, p["end_ms"] % 89 / 89, (p["end_ms"] - p["start_ms"]) % 83 / 83] for p in plans]


def context_model(texts: list) -> list:
    """The context analysis: one chapter, named by the text's first word."""
    return [{"domain": "talk", "chapters": [{"title": (t or "").split(" ")[0], "summary": str(len(t or ""))}]} for t in texts]


def letters_estimator(texts: list) -> list:
    """An engine's own length estimate: 70 ms a character; None for texts with a digit, which it can't tell."""
    return [None if t is None or any(c.isdigit() for c in t) else 70 * len(t) for t in texts]
