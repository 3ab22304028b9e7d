"""Schemas of events, constraints, chains and responses."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_ARGS = (
    "command string, path string, operation string, framework string, outcome string, tests_run int, error_type string, message string,"
    " tokens_used bigint, tokens_max bigint, from_phase string, to_phase string, reason string, trigger string, source string"
)
EVENT = f"struct<type:string,step:int,args:struct<{','.join(x.strip().replace(' ', ':') for x in EVENT_ARGS.split(','))}>>"
TRAJECTORY = f"task_id string, model string, agent string, outcome string, source string, events array<{EVENT}>, _corrupt_record string"

CONSTRAINT_FIELDS = [
    ("type", "string"),
    ("timestamp", "bigint"),
    ("resource", "string"),
    ("amount", "double"),
    ("decay", "string"),
    ("recover_in", "int"),
    ("tool", "string"),
    ("state", "string"),
    ("from_phase", "string"),
    ("to_phase", "string"),
    ("trigger", "string"),
    ("observable_added", "array<string>"),
    ("observable_removed", "array<string>"),
    ("uncertainty", "double"),
    ("role", "string"),
    ("dependency", "string"),
    ("expected_action", "string"),
    ("objective", "string"),
    ("weight_shift", "string"),
]
CONSTRAINT_TYPES = ("ResourceBudget", "ToolAvailability", "SubGoalTransition", "InformationState", "CoordinationDependency", "OptimizationCriterion")
CONSTRAINT = "struct<" + ",".join(f"{n}:{t}" for n, t in CONSTRAINT_FIELDS) + ">"
CHAIN = (
    f"chain_id string, match_id string, source string, task_id string, constraints array<{CONSTRAINT}>,"
    " active_pair_by_step array<array<string>>, rendered string, cutoff_k int, action_at_step string,"
    " per_step_actions array<struct<step_idx:int,action:string>>, _corrupt_record string"
)
RESPONSE = "chain_id string, model string, seed int, source string, cutoff_k int, response string, prompt_version string, temperature double"


def struct(ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)
