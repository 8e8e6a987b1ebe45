"""Where records come from: flow-export datagrams, JSON messages, landing logs, message buses."""
