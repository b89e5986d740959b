"""Sinks: bundles, exports, the event store and the case repository."""
