"""Tables of the engine and their fixed vocabularies."""

from __future__ import annotations

SCHEMA_VERSION = "graph/v1"

TABLES = {
    "nodes": "id string, type string, name string, path string, status string, metadata map<string,string>, created_at timestamp, updated_at timestamp",
    "edges": "from_id string, to_id string, type string, confidence double, source string, subtype string, note string, created_at timestamp",
    "search_docs": "node_id string, title string, rel_path string, scope string, body string, summary string, aliases array<string>, tags array<string>, tracked_state string, updated_at timestamp",
    "indexed_files": "rel_path string, repo_root string, node_id string, tracked_state string, content_hash string, mtime_ns bigint, parser_kind string, scope_id string, indexed_at timestamp",
    "graph_meta": "key string, value string",
    "postings": "term string, node_id string, col int, pos int",
    "sizes": "node_id string, len int",
}
ENTRIES = "abs_path string, rel_path string, repo_root string, rel_to_repo string, git_state string, is_ignored boolean, is_dir boolean, extension string, path_depth int, size bigint, mtime_ns bigint"
BOUNDARIES = "abs_path string, rel_path string, is_root boolean, is_submodule boolean, git_dir string"
EVENTS = (
    "v int, id string, ts string, kind string, action string, "
    "scope struct<campaign:string,festival:string,phase:string,sequence:string,task:string,intent:string,workitem:string,quest:string>, "
    "actor struct<type:string,name:string>, why string, payload string, "
    "evidence array<struct<type:string,repo:string,sha:string,path:string,url:string>>, source string"
)

# Types of nodes in the order results are grouped by.
NODE_TYPES = "project festival phase sequence task intent design_doc explore_doc note canvas attachment tag chain repo folder package type_def function file".split()
#: types that are listed without a place in the order come last.
UNRANKED = 100
# Types that can be searched.
INDEXED_TYPES = "project festival chain phase sequence task intent design_doc explore_doc file package decision action note".split()
# Relation modes and the edge source each lets through; hybrid and unknown modes let all through.
MODE_SOURCES = {"structural": "structural", "explicit": "explicit", "semantic": "inferred"}
# Well-known folders.
BUCKETS = ["projects", "festivals", "workflow", "workflow/design", "workflow/explore", ".campaign", ".campaign/intents"]
# Kinds of scope folders by rank.
SCOPE_RANK = {"campaign_root": 0, "repo_root": 1, "submodule_root": 1, "campaign_bucket": 2, "artifact_scope": 3, "user_scope": 4}
# Evidence weights, and the source order in which candidates are drawn.
EVIDENCE_WEIGHTS = {"same_folder": "0.35", "shared_ancestor": "0.20", "shared_tag": "0.30", "shared_frontmatter": "0.25", "shared_repo_root": "0.10", "shared_tokens": "0.20", "artifact_owned": "0.25"}
# Languages of code files by extension.
CODE_LANGUAGES = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "java": "java", "rb": "ruby", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp"}
# Shape, line and fill colour of a node type in drawings.
STYLES = {
    "project": ("box", "#00BCD4", "#E0F7FA"),
    "festival": ("hexagon", "#E040FB", "#F3E5F5"),
    "chain": ("component", "#FF9800", "#FFF3E0"),
    "phase": ("folder", "#FDD835", "#FFFDE7"),
    "sequence": ("note", "#66BB6A", "#E8F5E9"),
    "task": ("ellipse", "#78909C", "#ECEFF1"),
    "intent": ("diamond", "#42A5F5", "#E3F2FD"),
    "design_doc": ("tab", "#EF5350", "#FFEBEE"),
    "explore_doc": ("tab", "#AB47BC", "#F3E5F5"),
    "file": ("note", "#BDBDBD", "#F5F5F5"),
    "function": ("cds", "#26A69A", "#E0F2F1"),
    "type_def": ("record", "#5C6BC0", "#E8EAF6"),
    "package": ("box3d", "#7E57C2", "#EDE7F6"),
}
DEFAULT_STYLE = ("ellipse", "#9E9E9E", "#FAFAFA")
