"""The slot for translation models, and doubles that need none.

A backend is a function that is built once per task and takes a list of texts; a model is loaded there and reused for all
batches of the task. Errors that concern one text come back as a reason beside an empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from typing import TypeVar

Reply = tuple[str, str | None]
Backend = Callable[[list[str]], list[Reply]]
T = TypeVar("T")
Steps = Generator[list[str], list[Reply], T]  # work on one text that asks for translations, gets the replies, and returns its result


def together(work: list[Steps[T]]) -> Steps[list[T]]:
    """Several pieces of work as one, which asks at a time for whatever all of them ask."""
    results: list = [None] * len(work)
    replies: dict[int, list[Reply] | None] = dict.fromkeys(range(len(work)))
    while replies:
        asked: dict[int, list[str]] = {}
        for k, reply in replies.items():
            try:
                asked[k] = work[k].send(reply)
            except StopIteration as done:
                results[k] = done.value
        out = iter((yield [t for some in asked.values() for t in some]) if asked else ())
        replies = {k: [next(out) for _ in some] for k, some in asked.items()}
    return results


def answered(work: list[Steps[T]], backend: Backend) -> list[T]:
    """The results of all the work; the backend is called once for whatever all of it asks at a time."""
    steps = together(work)
    replies: list[Reply] | None = None
    try:
        while True:
            texts = steps.send(replies)
            replies = backend(texts) if texts else []
            if len(replies) != len(texts):
                raise RuntimeError("a backend must reply to every text")
    except StopIteration as done:
        return done.value


def budget(count: Callable[[str], int], limit: int, share: float = 1.0, specials: int = 2) -> Callable[[str], bool]:
    """Whether a text fits into a model: its tokens and the special ones are at most a share of the limit.

    ``count`` is the slot for a tokenizer. A source leaves a quarter of the room for a target that is longer: a share of 0.75.
    """
    most = int(limit * share)
    return lambda text: count(text) + specials <= most


def echo() -> Backend:
    return lambda texts: [(t, None) for t in texts]


def upper() -> Backend:
    return lambda texts: [(t.upper(), None) for t in texts]


def dictionary(words: dict[str, str]) -> Callable[[], Backend]:
    """Word by word; words that are not in the dictionary stay."""
    import re

    def make() -> Backend:
        pattern = re.compile(r"\w+")
        one = lambda m: words.get(m[0].lower(), m[0])
        return lambda texts: [(pattern.sub(one, t), None) for t in texts]

    return make


def failing(word: str) -> Callable[[], Backend]:
    """Upper case, but texts with a certain word fail and texts that mention ``drop`` lose their last word: for tests of recovery."""

    def make() -> Backend:
        def run(texts: list[str]) -> list[tuple[str, str | None]]:
            return [("", f"the backend cannot translate {word}") if word in t else (t.rsplit(" ", 1)[0] if "drop" in t else t.upper(), None) for t in texts]

        return run

    return make


BACKENDS: dict[str, Callable[[], Backend]] = {"echo": echo, "upper": upper}
