"""Signatures against the published vectors of RFC 8032, section 7.1."""

import pytest

from tidelog.functions import signing

VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


@pytest.mark.parametrize(("seed", "key", "message", "signature"), VECTORS)
def test_vectors(seed, key, message, signature):
    seed, key, message, signature = map(bytes.fromhex, (seed, key, message, signature))
    assert signing.public_key_of(seed) == key and signing.sign(seed, message) == signature
    assert signing.verify(key, message, signature)
    assert not signing.verify(key, message + b"x", signature) and not signing.verify(key, message, signature[:63]) and not signing.verify(key[:31], message, signature)
    assert not signing.verify(None, message, signature) and not signing.verify(key, message, signature[:32] + b"\xff" * 32)
