"""Writers and text exports."""
