"""Steps of a federated plan: checked, run layer by layer, merged."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from enum import StrEnum
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from factweave.operators.predicates import RequestRefused


class Status(StrEnum):
    SUCCESS = "SUCCESS"
    FAILED = "FAILED"
    SKIPPED = "SKIPPED"
    TIMED_OUT = "TIMED_OUT"


class StepFailed(RuntimeError):
    """A step could not do its work; its dependants are skipped. Other errors are bugs and pass through."""


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[Mapping[str, StepResult]], StepResult]
    needs: tuple[str, ...] = ()


@dataclass
class StepResult:
    """A step's rows; complete says they are all there are; identity names the snapshot they come from."""

    rows: DataFrame | None
    complete: bool = True
    identity: tuple = ()
    status: Status = Status.SUCCESS
    detail: str = ""


@dataclass
class Execution:
    results: dict[str, StepResult] = field(default_factory=dict)


def layers(steps: list[Step]) -> list[list[Step]]:
    """Steps in layers whose needs are met before; names twice, unknown needs and cycles are refused."""
    by_name = {s.name: s for s in steps}
    if len(by_name) != len(steps):
        raise RequestRefused("a step is given twice")
    unknown = [n for s in steps for n in s.needs if n not in by_name]
    if unknown:
        raise RequestRefused(f"unknown step {unknown[0]}")
    done: set[str] = set()
    out = []
    while len(done) < len(steps):
        layer = [s for s in steps if s.name not in done and done.issuperset(s.needs)]
        if not layer:
            raise RequestRefused("the steps form a cycle")
        out.append(layer)
        done.update(s.name for s in layer)
    return out


def plan_problems(steps: list[Step], asked: Mapping[str, str], covered: Mapping[str, tuple[str, ...]], constraints: list[str]) -> list[tuple[str, str]]:
    """(code, name) of what a plan invents, omits or leaves uncovered; must be empty before it runs.

    ``asked`` maps the steps a question needs to their operators, ``covered`` each planned step to (operator,
    constraints...).
    """
    names = [s.name for s in steps]
    out = [("STEP_INVENTED", n) for n in names if n not in asked] + [("STEP_OMITTED", n) for n in asked if n not in names]
    out += [("OPERATOR_CHANGED", n) for n in names if n in asked and covered.get(n, ("",))[0] != asked[n]]
    applied = {c for parts in covered.values() for c in parts[1:]}
    return out + [("CONSTRAINT_NOT_COVERED", c) for c in constraints if c not in applied]


def execute(steps: list[Step], timeout: float | None = 10.0, spark: SparkSession | None = None) -> Execution:
    """Run all steps, a layer's side by side; a step whose need did not succeed is skipped.

    Steps mostly compose lazy frames. A layer has ``timeout`` seconds from its start; a step that runs longer is given
    up at that moment: the wait ends, and if the session is given, the Spark jobs of its thread are cancelled.
    """
    out = Execution()
    for layer in layers(steps):
        pool = ThreadPoolExecutor(max_workers=max(1, len(layer)))
        running, tags = {}, {}
        for s in layer:
            if any(out.results[n].status is not Status.SUCCESS for n in s.needs):
                out.results[s.name] = StepResult(None, False, status=Status.SKIPPED, detail="a need did not succeed")
            else:
                tags[s.name] = f"step-{uuid4().hex}"
                running[s.name] = pool.submit(_tagged, spark, tags[s.name], s.run, {n: out.results[n] for n in s.needs})
        wait(running.values(), timeout)
        for name, future in running.items():
            if not future.done():
                future.cancel()
                if spark is not None:
                    spark.sparkContext.cancelJobsWithTag(tags[name])
                out.results[name] = StepResult(None, False, status=Status.TIMED_OUT)
                continue
            try:
                out.results[name] = future.result()
            except StepFailed as e:
                out.results[name] = StepResult(None, False, status=Status.FAILED, detail=str(e))
        pool.shutdown(wait=False)
    return out


def _tagged(spark: SparkSession | None, tag: str, run: Callable, needs: Mapping[str, StepResult]) -> StepResult:
    if spark is None:
        return run(needs)
    spark.sparkContext.addJobTag(tag)
    try:
        return run(needs)
    finally:
        spark.sparkContext.removeJobTag(tag)


def final_names(steps: list[Step], execution: Execution) -> list[str]:
    """Successful steps that no successful step builds on."""
    good = {n for n, r in execution.results.items() if r.status is Status.SUCCESS}
    used = {n for s in steps if s.name in good for n in s.needs}
    return [s.name for s in steps if s.name in good and s.name not in used]


def candidates_of(results: Mapping[str, StepResult], entity: str) -> DataFrame:
    """Entities all needed steps agree on. Each must be whole and from one snapshot; an empty one stays empty."""
    if not results:
        raise StepFailed("no candidates are given")
    for name, r in results.items():
        if r.status is not Status.SUCCESS or r.rows is None:
            raise StepFailed(f"{name} did not succeed")
        if not r.complete:
            raise StepFailed(f"{name} is not complete")
    if len({r.identity for r in results.values()}) > 1:
        raise StepFailed("the steps read different snapshots")
    from factweave.operators.merge import intersected

    return intersected([r.rows for r in results.values()], entity)
