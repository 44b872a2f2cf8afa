"""The edge to language models: messages, a provider protocol, the tool loop."""
