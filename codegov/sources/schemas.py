"""Fixed schemas of facts, findings and ledger events; nothing is inferred."""

from __future__ import annotations

ARTIFACTS = "array<struct<kind:string,data:string>>"
FACTS = {
    "depends_on": "from_path string, from_pkg_name string, from_pkg_root string, file string, line int, column int, to_path string, is_external boolean, to_pkg_name string, to_pkg_root string",
    "packages": "name string, root_path string",
    "function_signatures": "file string, name string, parameters array<struct<name:string,type:string,position:int>>, input_heterogeneous boolean, return_type string, output_heterogeneous boolean, return_sites array<struct<value:string,guard:string,file:string,line:int,column:int>>, line int, column int, exported boolean",
    "call_nodes": "id string, file string, name string, kind string, line int, column int",
    "call_edges": "caller_id string, callee_id string, file string, line int, column int",
    "constants": "file string, kind string, value string, line int, column int",
    "algorithmic_bindings": "pattern_id string, role string, binding_key string, function_name string, file string, line int, column int, containing_function string",
    "positional_sources": "file string, name string, type string, positions array<struct<index:int,type:string>>, is_heterogeneous boolean, line int, column int",
    "positional_accesses": "file string, name string, type string, accessed_index string, access_kind string, origin_file string, origin_name string, line int, column int",
    "git_commits": "hash string, author string, author_email string, date timestamp, subject string",
    "git_file_changes": "hash string, path string, status string, old_path string",
}
FINDING = f"rule_id string, instance_id string, fingerprint string, message string, artifacts {ARTIFACTS}, requires_verification boolean"
LEDGER = (
    f"entry_id string, run_id string, timestamp timestamp, type string, fingerprint string, rule_id string, instance_id string, message string, artifacts {ARTIFACTS}, reason string, "
    "expires_at timestamp, requires_verification boolean, axiom_id string, scope string, claim string, note string, fingerprints array<string>"
)
