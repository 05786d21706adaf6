"""operators of the network and contrast analytics."""
