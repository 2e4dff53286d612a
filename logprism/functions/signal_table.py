"""The patterns that mark a log line as language-model or agent activity."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Signal:
    label: str
    framework: str | None
    pattern: str
    # Lower-case literals of which every match holds at least one. Looking for
    # them first is much cheaper than running the pattern on each line.
    needles: tuple[str, ...]


# Labels, frameworks and patterns, in the order that decides ties.
# The patterns are unanchored and ignore case, so "storage" does match "RAG".
SIGNALS = (
    Signal(
        "openai_api_call",
        "openai",
        r"(openai|gpt-[34o]|chatgpt|completions?|chat\.completions?)",
        ("openai", "gpt", "completion"),
    ),
    Signal(
        "anthropic_api_call",
        "anthropic",
        r"(anthropic|claude-[23]|claude-opus|claude-sonnet|claude-haiku)",
        ("anthropic", "claude-"),
    ),
    Signal(
        "llm_token_usage",
        None,
        r"(prompt_tokens|completion_tokens|total_tokens|usage\s*[:=]\s*\{)",
        ("_tokens", "usage"),
    ),
    Signal(
        "llm_finish_reason",
        None,
        r"""finish_reason\s*[:=]\s*["']?(stop|length|tool_calls|content_filter)""",
        ("finish_reason",),
    ),
    Signal(
        "langchain_activity",
        "langchain",
        r"(langchain|LLMChain|AgentExecutor|PromptTemplate|BaseTool|ConversationChain)",
        ("langchain", "llmchain", "agentexecutor", "prompttemplate", "basetool", "conversationchain"),
    ),
    Signal(
        "langgraph_activity",
        "langgraph",
        r"(langgraph|StateGraph|CompiledGraph|add_node|add_edge|invoke\()",
        ("langgraph", "stategraph", "compiledgraph", "add_node", "add_edge", "invoke("),
    ),
    Signal(
        "autogen_activity",
        "autogen",
        r"(autogen|AssistantAgent|UserProxyAgent|GroupChat|initiate_chat)",
        ("autogen", "assistantagent", "userproxyagent", "groupchat", "initiate_chat"),
    ),
    Signal(
        "crewai_activity",
        "crewai",
        r"(crewai|CrewAI|Crew\(|Agent\(|Task\(|crew\.kickoff)",
        ("crewai", "crew(", "agent(", "task(", "crew.kickoff"),
    ),
    Signal(
        "llamaindex_activity",
        "llamaindex",
        r"(llama.?index|LlamaIndex|VectorStoreIndex|QueryEngine|ServiceContext)",
        ("llama", "vectorstoreindex", "queryengine", "servicecontext"),
    ),
    Signal(
        "haystack_activity",
        "haystack",
        r"(haystack|Pipeline\.run|DocumentStore|Retriever|Generator)",
        ("haystack", "pipeline.run", "documentstore", "retriever", "generator"),
    ),
    Signal(
        "tool_call",
        None,
        r"""(tool_call|function_call|tool_use|"name"\s*:\s*"[a-z_]+"|calling tool)""",
        ("tool_call", "function_call", "tool_use", '"name"', "calling tool"),
    ),
    Signal(
        "tool_result",
        None,
        r"(tool_result|function_result|observation\s*[:=]|Action Input|Action Output)",
        ("tool_result", "function_result", "observation", "action input", "action output"),
    ),
    Signal(
        "vector_retrieval",
        None,
        r"(vector.?store|embedding|similarity.?search|nearest.?neighbor|cosine.?sim)",
        ("vector", "embedding", "similarity", "nearest", "cosine"),
    ),
    Signal(
        "rag_activity",
        None,
        r"(retrieval.?augmented|RAG|context.?window|augment.*context|retrieved.*chunks?)",
        ("retriev", "rag", "context"),
    ),
    Signal(
        "system_prompt",
        None,
        r"""(system\s*[:=]\s*["'\{]|"role"\s*:\s*"system"|system_message)""",
        ("system",),
    ),
    Signal(
        "prompt_template",
        None,
        r"(PromptTemplate|FewShotPrompt|ChatPromptTemplate|\{[a-z_]+\}.*\{[a-z_]+\})",
        ("prompttemplate", "fewshotprompt", "{"),
    ),
    Signal(
        "chain_of_thought",
        None,
        r"(chain.of.thought|step.by.step|let.me.think|reasoning\s*[:=]|Thought\s*:)",
        ("thought", "step", "think", "reasoning"),
    ),
    Signal(
        "agent_action",
        None,
        r"(Action\s*:\s*\w|Observation\s*:|Final Answer\s*:|PAUSE|REFLECT|PLAN)",
        ("action", "observation", "final answer", "pause", "reflect", "plan"),
    ),
    Signal(
        "rate_limit_retry",
        None,
        r"(rate.?limit|retry.?after|exponential.?backoff|too.?many.?requests|429)",
        ("limit", "retry", "backoff", "request", "429"),
    ),
    Signal(
        "context_overflow",
        None,
        r"(context.?length|token.?limit|max.?tokens|context.?window.?exceeded|truncat)",
        ("context", "token", "truncat"),
    ),
)
