"""Where records go: the partitioned flow table, JSON message folders, message buses."""
