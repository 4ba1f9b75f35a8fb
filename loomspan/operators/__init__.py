"""Node types: each builds the columns of its output ports from those of its inputs."""

from .base import Built, Call, NodeType, Registry, Value
from .chat import CHAT
from .context import CONTEXT
from .flow import FLOW
from .jsons import JSON
from .plugins import PLUGINS
from .text import TEXT

BUILT_IN: Registry = Registry([*FLOW, *TEXT, *JSON, *CHAT, *CONTEXT, *PLUGINS])

__all__ = ["BUILT_IN", "Built", "Call", "NodeType", "Registry", "Value"]
