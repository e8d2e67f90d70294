"""Prompt templates by stage. The ones with ``reasoning`` ask for a thought-out answer."""

from __future__ import annotations

from answerloom.functions.text import Template

_SOURCES = "Possibly related posts:\n{context}\n"

_DRAFT = "Answer this programming question. Use the posts below where they help.\n\nQuestion:\n{question}\n\n" + _SOURCES

_FEEDBACK = (
    "Check the draft answer below against its question and the posts. Name no more than {max_feedback} "
    "points to improve: mistakes first, then gaps, then unclear wording.\n\n"
    "Question:\n{question}\n\nDraft:\n{draft}\n\n" + _SOURCES + "\nPoints, numbered, {max_feedback} at most:"
)

_REFINED = (
    "Improve the draft answer by working in the points below. Leave sentences that no point concerns as "
    "they are, and repeat nothing.\n\n"
    "Question:\n{question}\n\nDraft:\n{draft}\n\nPoints:\n{feedback}\n\n" + _SOURCES
)

_THINK = "First work through the problem step by step without writing the steps down. Then do the following.\n\n"

_CHOICE = (
    "Two answers to one question follow. Decide which one is right, to the point and complete, going by the "
    "posts. End with \\boxed{{A}} or \\boxed{{B}}.\n\nQuestion:\n{question}\n\n" + _SOURCES
)

_ANSWERS = "\nAnswer A:\n{response_a}\n\nAnswer B:\n{response_b}\n"

_JUDGE = (
    "Say how alike the two answers are, from 0 (not at all) to 1 (the same). End with \\boxed{{number}}.\n\n"
    "First answer:\n{prediction}\n\nSecond answer:\n{truth}\n"
)

DRAFT, FEEDBACK, REFINED = "draft", "feedback", "refined"
DRAFT_CHOICE, REFINED_CHOICE = "draft_choice", "refined_choice"
BASELINE, JUDGE = "baseline", "judge"

_TEXTS = {
    DRAFT: _DRAFT,
    FEEDBACK: _FEEDBACK,
    REFINED: _REFINED,
    DRAFT_CHOICE: _CHOICE + _ANSWERS,
    REFINED_CHOICE: _CHOICE + "\nFirst draft:\n{draft}\n\nPoints raised:\n{feedback}\n" + _ANSWERS,
    BASELINE: "{question}",
    JUDGE: _JUDGE,
}
_WITH_REASONING = (DRAFT, FEEDBACK, REFINED)


#: Texts of one's own in place of the templates above, as (stage, text).
Templates = tuple[tuple[str, str], ...]


def template(stage: str, reasoning: bool = False, own: Templates = ()) -> Template:
    """The template of a stage. A text of one's own is taken as it is; it may use the slots that the stage fills."""
    if (text := dict(own).get(stage)) is not None:
        made = Template(text)
        if unknown := made.slots - Template(_TEXTS[stage]).slots:
            raise ValueError(f"{stage} has no {', '.join(sorted(unknown))}")
        return made
    lead = _THINK if reasoning and stage in _WITH_REASONING else ""
    return Template(lead + _TEXTS[stage])
