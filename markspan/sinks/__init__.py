"""Text forms of nets and state trees, as ordered lines."""
