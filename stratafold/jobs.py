"""Independent Spark jobs at the same time: small ones wait for the driver's planning more than for executors."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Calls of one set that run at once.
AT_ONCE = 6


def together(*calls: Callable[[], Any]) -> list[Any]:
    """Results of the calls in their order; the first error is raised once all have ended."""
    if len(calls) < 2:
        return [call() for call in calls]
    session = SparkSession.getActiveSession()
    bound = inheritable_thread_target(session) if session else inheritable_thread_target
    with ThreadPoolExecutor(min(AT_ONCE, len(calls))) as pool:
        running = [pool.submit(copy_context().run, bound(call)) for call in calls]
    return [job.result() for job in running]
