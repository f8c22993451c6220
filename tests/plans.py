"""Helpers that look at executed plans."""

from __future__ import annotations


def executed(frame) -> str:
    """Physical plan of a frame that adaptive execution has already run."""
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0]


def final_plan(frame) -> str:
    frame.collect()
    return executed(frame)


def planned(frame) -> str:
    """Physical plan before it runs."""
    return frame._jdf.queryExecution().executedPlan().toString()
