"""Images, folders, rule files and manifests as tables."""
