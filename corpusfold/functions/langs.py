"""Fixed lookup values: supported extensions, syntax families, import prefixes, key lists.

Every table in this module is a fixed value of the data model: results depend on these exact words.
"""

from __future__ import annotations

# fixed values: extensions taken into the corpus
EXTENSIONS = (
    "js", "jsx", "ts", "tsx", "py", "rs", "go", "java", "cs", "swift", "kt", "c", "h", "cpp",
    "hpp", "m", "mm", "vue", "svelte", "astro", "html", "md", "json", "yaml", "yml", "toml",
)

# fixed values: extension -> syntax family
SYNTAX = {
    "js": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "py": "python",
    "rs": "rust",
    "go": "go",
    "java": "java",
    "cs": "csharp",
    "swift": "swift",
    "kt": "kotlin",
    "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp",
    "m": "objc", "mm": "objc",
    "vue": "web", "svelte": "web", "astro": "web", "html": "web",
    "md": "markdown",
    "json": "config", "yaml": "config", "yml": "config", "toml": "config",
}

CODE_SYNTAXES = (
    "javascript", "typescript", "python", "rust", "go", "java", "csharp", "swift", "kotlin", "c", "cpp",
)

# fixed values: how a line starts that counts as an import, per syntax family
IMPORT_PREFIXES = {
    "javascript": ("import ", "import{"),
    "typescript": ("import ", "import{"),
    "python": ("import ", "from "),
    "rust": ("use ",),
    "go": ("import ",),
    "java": ("import ",),
    "kotlin": ("import ",),
    "swift": ("import ",),
    "csharp": ("using ",),
    "c": ("#include ", "#import "),
    "cpp": ("#include ", "#import "),
    "objc": ("#include ", "#import "),
}

IMPORT_KEEP = 5
LINE_TOKEN_LIMIT = 80

# fixed values: path components and file names that mark generated or vendored files
GENERATED_COMPONENTS = (
    "node_modules", "vendor", "vendors", "third_party", "third-party", "external", "generated",
    "__generated__", "dist", "build", "out", "target",
)
LOCKFILES = (
    "package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "pnpm-lock.yml", "yarn.lock",
    "bun.lock", "bun.lockb", "cargo.lock", "poetry.lock", "pdm.lock", "composer.lock",
    "gemfile.lock", "go.sum",
)
GENERATED_NAME_PARTS = ("generated", ".gen.", "_gen.")
GENERATED_NAME_ENDINGS = (".pb.go", ".pb.rs", ".pb.swift")

# fixed values: names and extensions that raise a file's priority
PRIORITY_MANIFESTS = (
    "Cargo.toml", "package.json", "package-lock.json", "tsconfig.json", "README.md", "AGENTS.md",
    "CLAUDE.md", "Dockerfile", "Makefile",
)
PRIORITY_ENTRY_POINTS = (
    "main.rs", "main.ts", "main.js", "main.py", "index.ts", "index.js", "app.ts", "app.js",
    "server.ts", "server.js",
)
PRIORITY_CONFIG_EXTENSIONS = ("toml", "json", "yaml", "yml", "md")
PRIORITY_SCORES = {"manifest": 5000, "entry_point": 4000, "workflow": 3000, "config": 2000}

# fixed values: code-fence languages whose bodies are kept
FENCE_LANGUAGES = (
    "sh", "bash", "shell", "text", "txt", "rust", "rs", "js", "jsx", "ts", "tsx", "python", "py",
    "json", "yaml", "yml", "toml",
)

# fixed values: Objective-C line starts kept at depth zero, and first words of C-like declarations
OBJC_DIRECTIVES = (
    "#import", "#include", "#define", "#pragma", "@class", "@protocol", "@interface",
    "@implementation", "@end", "@property", "@synthesize", "@dynamic",
)
OBJC_SHAPE_WORDS = (
    "class", "struct", "enum", "namespace", "template", "typedef", "using", "extern", "static",
    "const", "void", "int", "bool", "float", "double", "std", "NSString", "NSArray",
    "NSDictionary", "instancetype",
)

# fixed values: configuration keys worth keeping, common and per manifest profile
CONFIG_KEYS = {
    "common": (
        "name", "version", "description", "displayname", "scripts", "dependencies",
        "devdependencies", "peerdependencies", "optionaldependencies", "workspaces", "jobs",
        "steps", "runs-on", "plugins", "skills", "contributes", "activationevents", "commands",
        "configuration", "package", "bin", "env", "permissions", "services", "matrix",
    ),
    "package_json": (
        "type", "private", "main", "module", "types", "exports", "imports", "files", "engines",
        "packagemanager", "repository", "license", "author", "publisher", "categories", "icon",
        "homepage", "bugs", "overrides", "resolutions",
    ),
    "workflow": (
        "on", "push", "pull_request", "workflow_dispatch", "schedule", "branches", "paths",
        "defaults", "concurrency", "needs", "if", "uses", "run", "with", "strategy",
        "timeout-minutes",
    ),
    "cargo_toml": (
        "workspace", "features", "default", "lib", "bin", "example", "test", "bench", "target",
        "profile", "package.metadata", "build-dependencies", "dev-dependencies",
        "workspace.dependencies",
    ),
    "agent_plugin": (
        "author", "interface", "shortdescription", "longdescription", "developername", "category",
        "capabilities", "defaultprompt", "mcpservers", "apps",
    ),
    "editor_manifest": (
        "publisher", "engines", "vscode", "categories", "activationevents", "main", "browser",
        "extensionkind", "contributes", "commands", "command", "title", "menus", "keybindings",
        "configuration", "properties", "default", "enum",
    ),
}

# fixed values: keys that also match as a dotted prefix even though they hold no dot
CONFIG_PREFIX_KEYS = ("profile", "target")
