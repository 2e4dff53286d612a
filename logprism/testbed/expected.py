"""What the checks expect: stated here a second time, apart from the code under test."""

from __future__ import annotations

# Words for levels and the label each stands for, in the order in which lines are searched.
LEVEL_WORDS = (
    ("debug", "debug"),
    ("dbg", "debug"),
    ("trace", "trace"),
    ("trc", "trace"),
    ("info", "info"),
    ("information", "info"),
    ("inf", "info"),
    ("notice", "notice"),
    ("warn", "warn"),
    ("warning", "warn"),
    ("wrn", "warn"),
    ("error", "error"),
    ("err", "error"),
    ("critical", "critical"),
    ("crit", "critical"),
    ("fatal", "fatal"),
    ("alert", "alert"),
    ("emergency", "emergency"),
    ("emerg", "emergency"),
)

# Keys that carry a level, syslog severities 0 to 7, field types (later ones win ties).
JSON_LEVEL_KEYS = ("level", "severity", "lvl", "log_level")
LOGFMT_LEVEL_KEYS = ("level", "lvl", "severity", "log_level")
SYSLOG_LABELS = ("emergency", "alert", "critical", "error", "warn", "notice", "info", "debug")
TYPES = ("string", "number", "bool", "object", "array", "null")

# The field names that play each role.
TIMESTAMP_KEYS = ("time", "timestamp", "ts", "@timestamp", "date", "datetime")
LEVEL_KEYS = ("level", "severity", "log_level", "lvl", "loglevel")
MESSAGE_KEYS = ("message", "msg", "text", "body", "log")

# Label, framework and pattern of each signal, in the order that decides ties.
SIGNALS = (
    ("openai_api_call", "openai", r"(openai|gpt-[34o]|chatgpt|completions?|chat\.completions?)"),
    ("anthropic_api_call", "anthropic", r"(anthropic|claude-[23]|claude-opus|claude-sonnet|claude-haiku)"),
    ("llm_token_usage", None, r"(prompt_tokens|completion_tokens|total_tokens|usage\s*[:=]\s*\{)"),
    ("llm_finish_reason", None, r"""finish_reason\s*[:=]\s*["']?(stop|length|tool_calls|content_filter)"""),
    ("langchain_activity", "langchain", r"(langchain|LLMChain|AgentExecutor|PromptTemplate|BaseTool|ConversationChain)"),
    ("langgraph_activity", "langgraph", r"(langgraph|StateGraph|CompiledGraph|add_node|add_edge|invoke\()"),
    ("autogen_activity", "autogen", r"(autogen|AssistantAgent|UserProxyAgent|GroupChat|initiate_chat)"),
    ("crewai_activity", "crewai", r"(crewai|CrewAI|Crew\(|Agent\(|Task\(|crew\.kickoff)"),
    ("llamaindex_activity", "llamaindex", r"(llama.?index|LlamaIndex|VectorStoreIndex|QueryEngine|ServiceContext)"),
    ("haystack_activity", "haystack", r"(haystack|Pipeline\.run|DocumentStore|Retriever|Generator)"),
    ("tool_call", None, r"""(tool_call|function_call|tool_use|"name"\s*:\s*"[a-z_]+"|calling tool)"""),
    ("tool_result", None, r"(tool_result|function_result|observation\s*[:=]|Action Input|Action Output)"),
    ("vector_retrieval", None, r"(vector.?store|embedding|similarity.?search|nearest.?neighbor|cosine.?sim)"),
    ("rag_activity", None, r"(retrieval.?augmented|RAG|context.?window|augment.*context|retrieved.*chunks?)"),
    ("system_prompt", None, r"""(system\s*[:=]\s*["'\{]|"role"\s*:\s*"system"|system_message)"""),
    ("prompt_template", None, r"(PromptTemplate|FewShotPrompt|ChatPromptTemplate|\{[a-z_]+\}.*\{[a-z_]+\})"),
    ("chain_of_thought", None, r"(chain.of.thought|step.by.step|let.me.think|reasoning\s*[:=]|Thought\s*:)"),
    ("agent_action", None, r"(Action\s*:\s*\w|Observation\s*:|Final Answer\s*:|PAUSE|REFLECT|PLAN)"),
    ("rate_limit_retry", None, r"(rate.?limit|retry.?after|exponential.?backoff|too.?many.?requests|429)"),
    ("context_overflow", None, r"(context.?length|token.?limit|max.?tokens|context.?window.?exceeded|truncat)"),
)

# The Unicode White_Space characters.
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
