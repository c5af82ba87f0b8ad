"""The registry of event arguments and groups of them."""

from __future__ import annotations

from dataclasses import dataclass, replace

KINDS = {"Int": "bigint", "Float": "double", "String": "string", "Object": "variant"}


@dataclass(frozen=True)
class ArgSpec:
    """An argument: column name, key in the event's args, kind (Int, Float, String, Object) and default."""

    name: str
    raw: str
    kind: str
    default: object


# Columns, the keys that they come from, the kinds of their values, and what stands for a missing one.
REGISTRY: dict[str, ArgSpec] = {
    a.name: a
    for a in (
        ArgSpec("ev_idx", "Ev Idx", "Int", -1),
        ArgSpec("external_id", "External id", "Int", -1),
        ArgSpec("python_id", "Python id", "Int", -1),
        ArgSpec("python_parent_id", "Python parent id", "Int", -1),
        ArgSpec("fwd_thread_id", "Fwd thread id", "Int", -1),
        ArgSpec("sequence", "Sequence number", "Int", -1),
        ArgSpec("cbid", "cbid", "Int", -1),
        ArgSpec("correlation", "correlation", "Int", -1),
        ArgSpec("est_occupancy", "est. achieved occupancy %", "Int", -1),
        ArgSpec("bytes", "bytes", "Int", -1),
        ArgSpec("context", "context", "Int", -1),
        ArgSpec("device", "device", "Int", -1),
        ArgSpec("stream", "stream", "Int", -1),
        ArgSpec("queued", "queued", "Int", -1),
        ArgSpec("shared_memory", "shared memory", "Int", -1),
        ArgSpec("registers_per_thread", "registers per thread", "Int", -1),
        ArgSpec("wait_on_stream", "wait_on_stream", "Int", -1),
        ArgSpec("wait_on_cuda_event_record_corr_id", "wait_on_cuda_event_record_corr_id", "Int", -1),
        ArgSpec("op_count", "Op count", "Int", -1),
        ArgSpec("sort_index", "sort_index", "Int", -1),
        ArgSpec("process_rank", "Rank", "Int", -1),
        ArgSpec("seq_num", "Seq", "Int", -1),
        ArgSpec("batch_size", "batchSize", "Int", -1),
        ArgSpec("in_msg_nelems", "In msg nelems", "Int", 0),
        ArgSpec("out_msg_nelems", "Out msg nelems", "Int", 0),
        ArgSpec("in_msg_size", "In msg size", "Int", 0),
        ArgSpec("out_msg_size", "Out msg size", "Int", 0),
        ArgSpec("group_size", "Group size", "Int", 0),
        ArgSpec("warps_per_sm", "warps per SM", "Float", 0.0),
        ArgSpec("memory_bw_gbps", "memory bandwidth (GB/s)", "Float", 0.0),
        ArgSpec("kernel_backend", "kernel_backend", "String", ""),
        ArgSpec("kernel_hash", "kernel_hash", "String", ""),
        ArgSpec("finished", "finished", "String", ""),
        ArgSpec("labels", "labels", "String", ""),
        ArgSpec("collective_name", "Collective name", "String", ""),
        ArgSpec("msg_dtype", "dtype", "String", ""),
        ArgSpec("process_group_name", "Process Group Name", "String", ""),
        ArgSpec("process_group_desc", "Process Group Description", "String", ""),
        ArgSpec("batch_id", "batchId", "String", ""),
        ArgSpec("concrete_inputs", "Concrete Inputs", "Object", None),
        ArgSpec("input_dims", "Input Dims", "Object", None),
        ArgSpec("input_type", "Input type", "Object", None),
        ArgSpec("input_strides", "Input Strides", "Object", None),
        ArgSpec("blocks_per_sm", "blocks per SM", "Object", None),
        ArgSpec("block", "block", "Object", None),
        ArgSpec("grid", "grid", "Object", None),
        ArgSpec("in_split_size", "In split size", "Object", None),
        ArgSpec("out_split_size", "Out split size", "Object", None),
        ArgSpec("input_tensors_start", "Input Tensors start", "Object", None),
        ArgSpec("output_tensors_start", "Output Tensors start", "Object", None),
        ArgSpec("process_group_ranks", "Process Group Ranks", "Object", None),
        ArgSpec("pre_grad_nodes", "pre_grad_nodes", "Object", None),
    )
}

GROUPS = {
    "index": ["external_id", "python_id", "python_parent_id"],
    "input_shape": ["input_dims", "input_type", "input_strides"],
    "bandwidth": ["bytes", "memory_bw_gbps"],
    "sync": ["wait_on_stream", "wait_on_cuda_event_record_corr_id"],
    "minimum": ["stream", "correlation"],
    "info": ["labels", "sort_index"],
    "communication": ["collective_name", "in_msg_nelems", "out_msg_nelems", "msg_dtype", "group_size", "process_rank", "in_split_size", "out_split_size"],
    "triton": ["kernel_backend", "kernel_hash"],
}
GROUPS["default"] = [a for g in ("minimum", "bandwidth", "sync", "input_shape", "index", "communication") for a in GROUPS[g]]
GROUPS["complete"] = [a for a in REGISTRY if a not in GROUPS["info"]]


@dataclass(frozen=True)
class ParserOptions:
    """What to read: arguments, categories to skip, row drops, rounding, the longest duration to keep (µs; none by default)."""

    args: tuple[ArgSpec, ...] = tuple(REGISTRY[a] for a in GROUPS["default"])
    skip_categories: tuple[str, ...] = ()
    drop_gpu_annotations: bool = False
    drop_python_functions: tuple[str, ...] = ()
    round_ns: bool = False
    max_duration_us: float | None = None

    def with_args(self, *groups_or_specs: str | ArgSpec) -> ParserOptions:
        """The same with further arguments, each a spec, a registered name or a group."""
        found = {a.name: a for a in self.args}
        for g in groups_or_specs:
            for spec in [g] if isinstance(g, ArgSpec) else [REGISTRY[a] for a in GROUPS.get(g, [g])]:
                found[spec.name] = spec
        return replace(self, args=tuple(found.values()))

    def only(self, *names: str) -> ParserOptions:
        return replace(self, args=tuple(a for a in self.args if a.name in names))
