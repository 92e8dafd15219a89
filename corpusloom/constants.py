"""Word lists, patterns, prompts and limits that decide results.

Everything in this module is data, not logic.  The values have to be exactly
these for the engine's output to be interchangeable with datasets that were
built elsewhere from the same rules.
"""

# --- fixed values: file selection ------------------------------------------
# extension -> language, in scan order (the order is significant)
LANGUAGE_BY_EXTENSION = (
    (".py", "python"),
    (".js", "javascript"),
    (".ts", "javascript"),
    (".java", "java"),
    (".cpp", "cpp"),
    (".c", "cpp"),
    (".h", "cpp"),
    (".hpp", "cpp"),
    (".go", "go"),
    (".rs", "rust"),
)

# substrings of a path that exclude a file
IGNORED_PATH_PARTS = (
    "node_modules", "__pycache__", ".git", "venv", "env",
    "build", "dist", ".pytest_cache", "target", "bin", "obj",
    "vendor", ".next", "coverage", ".nyc_output", "migrations",
)

MIN_FILE_BYTES = 100
MAX_FILE_BYTES = 100_000
PROFILE_FILES = 50
MAX_EXAMPLES = 5000

# --- fixed values: text ------------------------------------------------------
# code points that count as white space when stripping text
WHITESPACE_CODEPOINTS = (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760,
    8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202,
    8232, 8233, 8239, 8287, 12288,
)

COMPLEXITY_KEYWORDS = (
    "if", "for", "while", "try", "except", "with", "def", "class",
    "function", "switch", "case",
)
MAX_COMPLEXITY = 20

GENERIC_NAMES = ("test", "temp", "tmp", "foo", "bar", "example", "demo")
PREFERRED_NAMING = ("snake_case", "camelCase", "PascalCase")
MIN_UNIT_LINES = 3
MAX_UNIT_LINES = 100
MAX_PYTHON_FUNCTION_LINES = 50
MIN_NONBLANK_LINES = 2

# --- fixed values: code unit patterns ---------------------------------------
# Plain form.  BODY accepts one level of nested braces.
BODY = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
UNIT_PATTERNS = {
    "javascript_function": r"function\s+(\w+)\s*\([^)]*\)\s*" + BODY,
    "javascript_arrow_function":
        r"const\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>\s*" + BODY,
    "javascript_class": r"class\s+(\w+)(?:\s+extends\s+\w+)?\s*" + BODY,
    "java_method":
        r"(public|private|protected)\s+(?:static\s+)?(?:\w+\s+)*(\w+)\s*\([^)]*\)\s*"
        r"(?:throws\s+\w+(?:\s*,\s*\w+)*)?\s*" + BODY,
    "java_class":
        r"(?:public\s+)?class\s+(\w+)(?:\s+extends\s+\w+)?"
        r"(?:\s+implements\s+\w+(?:\s*,\s*\w+)*)?\s*" + BODY,
    "cpp_function":
        r"\b(?:inline\s+)?\w+(?:\s*\*+|\s*&+)?\s+(\w+)\s*\([^)]*\)\s*(?:const\s*)?" + BODY,
    "cpp_class":
        r"class\s+(\w+)(?:\s*:\s*(?:public|private|protected)\s+\w+)?\s*" + BODY,
    "go_function":
        r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\([^)]*\)(?:\s*\([^)]*\)|\s*\w+)?\s*" + BODY,
    "go_struct": r"type\s+(\w+)\s+struct\s*\{[^{}]*\}",
    "rust_function":
        r"(?:pub\s+)?fn\s+(\w+)(?:<[^>]*>)?\s*\([^)]*\)(?:\s*->\s*[^{]+)?\s*" + BODY,
    "rust_struct": r"(?:pub\s+)?struct\s+(\w+)(?:<[^>]*>)?\s*\{[^{}]*\}",
}

# kind, language, name group, minimum lines, instruction prefix, context suffix
# (a suffix of None stands for the repository's style context)
UNIT_KINDS = (
    ("javascript_function", "javascript", 1, 3, "Write a JavaScript function named ", None),
    ("javascript_arrow_function", "javascript", 1, 3, "Create an arrow function named ",
     "Modern JavaScript style"),
    ("javascript_class", "javascript", 1, 5, "Create a JavaScript class named ", None),
    ("java_method", "java", 2, 4, "Write a Java method named ", "Java method"),
    ("java_class", "java", 1, 8, "Create a Java class named ", "Java class structure"),
    ("cpp_function", "cpp", 1, 4, "Write a C++ function named ", "C++ implementation"),
    ("cpp_class", "cpp", 1, 6, "Create a C++ class named ", "C++ class definition"),
    ("go_function", "go", 1, 3, "Write a Go function named ", "Go function"),
    ("go_struct", "go", 1, 1, "Define a Go struct named ", "Go struct definition"),
    ("rust_function", "rust", 1, 3, "Write a Rust function named ", "Rust function"),
    ("rust_struct", "rust", 1, 1, "Define a Rust struct named ", "Rust struct definition"),
)
CPP_CONTROL_WORDS = ("if", "for", "while", "switch", "return")

DOCUMENTED_FUNCTION_INSTRUCTION = (
    "Write a well-documented function following this project's documentation style"
)
DOCUMENTED_FUNCTION_MIN_CHARS = 20

# --- fixed values: style profile patterns -----------------------------------
JAVASCRIPT_NAME_PATTERNS = (
    ("functions", r"function\s+(\w+)"),
    ("functions", r"const\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>"),
    ("functions", r"(\w+)\s*:\s*(?:async\s+)?function"),
    ("classes", r"class\s+(\w+)"),
)
JAVA_NAME_PATTERNS = (
    ("functions", r"(?:public|private|protected)\s+(?:static\s+)?\w+\s+(\w+)\s*\("),
    ("classes", r"(?:public\s+)?class\s+(\w+)"),
)
MAIN_GUARD = 'if __name__ == "__main__"'
MAIN_GUARD_TAIL_LINES = 10
IMPORTS_PER_FILE = 5
IMPORTS_TOTAL = 50
DEFAULT_STYLE_CONTEXT = "Standard conventions"

# --- fixed values: chat records ----------------------------------------------
SYSTEM_MESSAGE = (
    "You are Qwen2.5-Coder, a helpful assistant that writes code following "
    "specific project conventions and style guidelines."
)
CHAT_ROLES = ("system", "user", "assistant")
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"

# --- fixed values: instruction generation -------------------------------------
GENERATION_SYSTEM_PROMPT = """
            You are a helpful coding assistant. You are 
            given lines of code and need to understand their purpose.
            Your task is to write a prompt that would generate the code above. 
            The prompt should be:
            - Not too long (1-2 sentences)
            - Look like it was written by a human developer
            - Be simple and direct
            - Focus on what the code does, not implementation details
            - Sound natural and conversational

            Answer only with the prompt, nothing else."""
GENERATION_PROMPT_HEAD = (
    "\n            " + GENERATION_SYSTEM_PROMPT
    + "\n            Code:\n            ```\n                "
)
GENERATION_PROMPT_TAIL = (
    "\n            ```\n            Generate a user prompt for this code:"
)
GENERATION_MODEL = "qwen2.5-coder:14b"
GENERATION_STOP = ("\n\n", "```")
PROMPT_CODE_LINES = 30
TRUNCATION_MARKER = "    # ... (truncated)"
RESPONSE_PREFIXES = (
    "Here's a prompt:",
    "Prompt:",
    "User prompt:",
    "The prompt would be:",
    "A suitable prompt would be:",
    "Here is a prompt:",
)
MIN_RESPONSE_CHARS = 10
MAX_RESPONSE_CHARS = 500
EMPTY_CODE_INSTRUCTION = "Write some code."

# --- fixed values: module spec defaults ---------------------------------------
SPEC_DEFAULTS = {
    "module_name": "unknown",
    "entity_name": "Unknown",
    "api_style": "rest",
    "base_path": "/api",
    "ui_framework": "react",
    "persistence": "postgres",
}

# kinds of units that Python's own parser finds
PYTHON_KINDS = ("python_function", "python_documented_function", "python_class")
