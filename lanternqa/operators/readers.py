"""Deterministic stand-ins for a model, so that every pipeline runs offline.

Each factory returns a small function from one prompt to one reply. They read
the prompt layout of `functions.prompts`.
"""

from __future__ import annotations

import json
import re


def _sections(prompt: str) -> tuple[str, str]:
    _, _, rest = prompt.partition("\n\nQuery:\n")
    query, _, text = rest.partition("\n\nText:\n")
    return query, text.removesuffix("\n")


def _words(text: str) -> set[str]:
    return set(re.findall(r"\w+", text.lower()))


def best_piece(field: str, separator: str):
    """Reply with the piece of the text that shares most distinct words with the query.

    The earliest of equal pieces wins; with no shared word the reply is plain
    prose, which strict parsing turns into the default.
    """

    def factory():
        def complete(prompt: str) -> str:
            query, text = _sections(prompt)
            wanted = _words(query)
            best, hits = None, 0
            for piece in text.split(separator):
                shared = len(wanted & _words(piece))
                if shared > hits:
                    best, hits = piece, shared
            if best is None:
                return "Nothing here bears on the query."
            return json.dumps({field: best}, ensure_ascii=False)

        return complete

    return factory


def covers_query(share: float):
    """Judge a text sufficient if it holds at least `share` of the query's distinct words."""

    def factory():
        def complete(prompt: str) -> str:
            query, text = _sections(prompt)
            wanted = _words(query)
            return json.dumps({"is_sufficient": len(wanted & _words(text)) >= share * len(wanted)})

        return complete

    return factory


def long_words(least: int):
    """Name the query's words of at least so many letters as keywords."""

    def factory():
        def complete(prompt: str) -> str:
            query = prompt.partition("\n\nQuery:\n")[2].removesuffix("\n")
            return json.dumps({"keywords": [w for w in re.findall(r"\w+", query) if len(w) >= least]}, ensure_ascii=False)

        return complete

    return factory


def sentence_questions():
    """Ask each sentence of a query as a question of its own, if there are several."""

    def complete(prompt: str) -> str:
        _, _, rest = prompt.partition("\n\nQuery:\n")
        query = rest.partition("\n\nAlready asked, do not repeat:\n")[0]
        parts = [s.strip(" \n.") for s in re.split(r"[.\n]", query)]
        parts = [s for s in parts if s]
        return json.dumps(
            {"needs_followup": len(parts) > 1, "questions": parts if len(parts) > 1 else []}, ensure_ascii=False
        )

    return complete


def first_sentence_meeting():
    """Read a message as a meeting: first sentence as topic, a clock time if one is written."""

    def complete(prompt: str) -> str:
        day = re.search(r"Today is (\d{4}-\d{2}-\d{2}) ", prompt).group(1)
        message = prompt.partition("\n\nMessage:\n")[2].removesuffix("\n")
        clock = re.search(r"\b([01][0-9]|2[0-3]):([0-5][0-9])\b", message)
        return json.dumps(
            {
                "location": "virtual",
                "start_time": f"{day}T{clock.group(0) if clock else '09:00'}",
                "topic": re.split(r"[.\n]", message)[0],
            },
            ensure_ascii=False,
        )

    return complete




def sentence_hops(rounds: int = 2):
    """Reason by asking the question's first sentence, then its last, then repeat the last finding.

    With `rounds` findings in the transcript it concludes.
    """

    def factory():
        def complete(prompt: str) -> str:
            head, _, transcript = prompt.rpartition("\nAre follow up questions needed here:")
            question = head.rpartition("Question: ")[2]
            found = transcript.split("Intermediate answer: ")[1:]
            parts = [s.strip() for s in re.split(r"[.\n]", question)]
            parts = [s for s in parts if s]
            if len(found) >= rounds or not parts:
                last = found[-1].split("\n")[0] if found else ""
                return f"\nSo the final answer is: {last}"
            return f"{' Yes.' if not found else ''}\nFollow up: {parts[0] if not found else parts[-1]}?"

        return complete

    return factory


def echo_turns():
    """`echo_turn` as a model that takes a list of prompts."""
    one = echo_turn()
    return lambda prompts: [one(prompt) for prompt in prompts]


echo_turns.takes_lists = True


def echo_turn():
    """Answer a chat turn with its own question: the whole turn, as a generator returns it."""

    def complete(prompt: str) -> str:
        question = prompt.removeprefix("<s>[INST] ").removesuffix(" [/INST]")
        return f"{prompt} {question}\n"

    return complete
