"""Schemas and vocabularies of the code-graph tables."""

from pyspark.sql import types as T

_S, _I, _L, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# Names and types of the columns of each table.
REPOSITORIES = _schema(("id", _S), ("url_or_path", _S), ("canonical_url", _S), ("name", _S), ("indexed_at", _TS), ("status", _S), ("progress_message", _S))
ENTITIES = _schema(
    ("id", _S), ("repo_id", _S), ("type", _S), ("name", _S), ("file_path", _S), ("start_line", _I), ("end_line", _I), ("parent_id", _S),
    ("language", _S), ("has_docstring", _B), ("source", _S), ("embedding", T.ArrayType(T.FloatType(), False)), ("created_at", _TS),
)
RELATIONSHIPS = _schema(
    ("id", _L), ("repo_id", _S), ("source_id", _S), ("target_id", _S), ("external_target_name", _S), ("type", _S), ("file_path", _S), ("line", _I)
)
USERS = _schema(("id", _S), ("external_id", _S), ("provider", _S), ("email", _S), ("api_token_hash", _S), ("created_at", _TS))
USER_REPOS = _schema(("user_id", _S), ("repo_id", _S), ("role", _S), ("granted_at", _TS))
CONVERSATION_MEMORY = _schema(
    ("id", _L), ("repo_id", _S), ("session_id", _S), ("feature_name", _S), ("summary", _S), ("source_entity_ids", T.ArrayType(_S)),
    ("graph_paths", T.ArrayType(_S)), ("confidence", _S), ("exploration_status", _S), ("repo_indexed_at", _TS), ("created_at", _TS),
)
CONVERSATIONS = _schema(
    ("id", _S), ("user_id", _S), ("repo_id", _S), ("summary", _S), ("summarized_through_turn", _I), ("created_at", _TS), ("updated_at", _TS)
)
CONVERSATION_TURNS = _schema(("id", _L), ("conversation_id", _S), ("turn_index", _I), ("role", _S), ("content", _S), ("created_at", _TS))
ASK_JOBS = _schema(
    ("id", _S), ("repo_id", _S), ("user_id", _S), ("status", _S), ("result", _S), ("error", _S), ("progress", _S), ("created_at", _TS), ("updated_at", _TS)
)
USER_FACTS = _schema(("id", _L), ("user_id", _S), ("category", _S), ("fact", _S), ("created_at", _TS), ("updated_at", _TS))
REPO_FACTS = _schema(("id", _L), ("user_id", _S), ("repo_id", _S), ("category", _S), ("fact", _S), ("created_at", _TS), ("updated_at", _TS))

# Vocabularies, ranks, extensions and entry-point rules.
ENTITY_TYPES = ("module", "class", "interface", "function", "method", "doc_block", "variable")
EDGE_TYPES = ("CONTAINS", "CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS", "INSTANTIATES")
EDGE_RANK = {"CALLS": 4, "INHERITS": 3, "IMPLEMENTS": 2, "INSTANTIATES": 2, "IMPORTS": 1, "CONTAINS": 0}
STATUSES = ("pending", "indexing", "ready", "failed", "cancelled")
SUPPORTED_EXTENSIONS = (".py", ".ts", ".tsx")
KNOWN_EXTENSIONS = {
    ".js": "JavaScript", ".jsx": "JavaScript", ".java": "Java", ".rb": "Ruby", ".go": "Go", ".rs": "Rust", ".cpp": "C++", ".cc": "C++",
    ".cxx": "C++", ".c": "C", ".cs": "C#", ".php": "PHP", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".r": "R",
    ".m": "MATLAB/Objective-C", ".lua": "Lua", ".ex": "Elixir", ".exs": "Elixir", ".hs": "Haskell", ".ml": "OCaml", ".clj": "Clojure",
    ".dart": "Dart", ".vue": "Vue", ".svelte": "Svelte",
}
ENTRY_FILENAMES = {
    "python": ("main.py", "run.py", "app.py", "cli.py", "manage.py", "wsgi.py", "asgi.py", "server.py", "__main__.py"),
    "typescript": ("index.ts", "main.ts", "server.ts", "app.ts", "index.tsx", "main.tsx"),
    "markdown": (),
}
ENTRY_PATTERNS = {
    "python": (r"if\s+__name__\s*==\s*[\"']__main__[\"']",),
    "typescript": (r"app\.listen\s*\(", r"server\.listen\s*\(", r"createServer\s*\(", r"bootstrap\s*\("),
    "markdown": (),
}
ENTRY_SCORES = {"filename": 10, "pattern": 5, "zero_in_degree": 3}
