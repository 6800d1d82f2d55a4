"""Digests of the canonical forms of whole licence texts that are too long to keep here, as
(identifier, digest, characters): with and without title and appendix, with the publisher's
addresses as they changed, and short licences with bullets for numbers.

They hold for ``license_scan.canonical``; when that changes they must be made again from
the texts.  Identifiers end in -only as a text can't tell if later versions are allowed.
"""

from __future__ import annotations

DIGESTS: list[tuple[str, str, int]] = [
    ("Apache-2.0", "1d09910dcaa7b6615415ceef642cc562", 8877),
    ("Apache-2.0", "3138c74e10d22fc7baaef3d18d1d7e26", 9812),
    ("Apache-2.0", "55a4f59b5c0290e6820bd4fc75acfad4", 8808),
    ("Apache-2.0", "58d9f953d851866cfd0937e1cbba78b2", 9889),
    ("Apache-2.0", "5d2795cb35f13d3f170c4a82e7d9f97f", 8865),
    ("Apache-2.0", "5de561a36337c6a271ea5c342338e1cb", 9820),
    ("Apache-2.0", "907c90224903199ffe6fc357841e86c5", 8837),
    ("Apache-2.0", "a59e158e01ad36133df5cf22ed3fe361", 9824),
    ("Apache-2.0", "dba7870df0465a45f5b83c2132d94321", 8796),
    ("Apache-2.0", "de3abe673cf17941240eb4a3be0deaa2", 9893),
    ("Apache-2.0", "e32aea965561f41a8390221b29af2726", 9881),
    ("Apache-2.0", "f569b691be9240b7dcb08194027c875e", 8768),
    ("Apache-2.0", "f5ef07e769bc3b27c121be254e46f90b", 8780),
    ("Apache-2.0", "f676e306be88bdb74f7e75908fbe3140", 8849),
    ("Artistic-1.0-Perl", "01df7f6ea86f898bbcf0a70d4960cbd2", 5802),
    ("Artistic-1.0-Perl", "c1b81bf4478b19597097b63e59382266", 5823),
    ("BSD-2-Clause", "813fd9d9ac9dc25946d47364f89d85b5", 1191),
    ("BSD-2-Clause", "e85f966e7ba23c76367a536eb0504232", 1212),
    ("BSD-3-Clause", "a80871edb57c9a6141d7b5660c958f08", 1377),
    ("BSD-3-Clause", "d2c3f28d44cd9132c482d9a75ad31aca", 1398),
    ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a", 1361),
    ("CC-BY-SA-4.0", "84bfd588f2236b2571476c5786cfdb16", 17454),
    ("CC-BY-SA-4.0", "f5d667e61beee864e3330158f1f13348", 17384),
    ("CC0-1.0", "45c5d7a28c1b2d2e39dd972af512dc3b", 6663),
    ("CC0-1.0", "d2a76f70ce19809695b7fb93c6241c23", 6691),
    ("GFDL-1.2-only", "2f240dc5f099df17785619c03b68a100", 19545),
    ("GFDL-1.2-only", "8d0843544e24727fdc5e9df92d1f8263", 19576),
    ("GFDL-1.3-only", "3b40153816a12b43c18cd45c45ac1e7b", 22006),
    ("GFDL-1.3-only", "84b68e103868bb1e478e2bbf38285db3", 21975),
    ("GPL-1.0-only", "144621ef5a09b5f767fa0f7461f93009", 9384),
    ("GPL-1.0-only", "29abd59bc8038038c6d2fc7a87de9be7", 9357),
    ("GPL-1.0-only", "42c3900f3df27526919a45781fcfaa40", 9412),
    ("GPL-1.0-only", "96c80989c16ae7b8154194f202511ae9", 9385),
    ("GPL-1.0-only", "b37a688f44419d3168b23775b65749eb", 11762),
    ("GPL-1.0-only", "d9c6ebec0c24967af7c5724b53230b81", 11735),
    ("GPL-2.0-only", "004c23e1de175f85ac3d5d8effee4dfe", 14453),
    ("GPL-2.0-only", "122d81285254aa6632106c3a67a4c632", 14452),
    ("GPL-2.0-only", "26f606e3d78ac5cd21540a2d8adde537", 14479),
    ("GPL-2.0-only", "322f86d85731e95450db6d10df1dbfb7", 14425),
    ("GPL-2.0-only", "40c4188f33c27e7291169679e87147a2", 17088),
    ("GPL-2.0-only", "422f821c6c0b1812cbde7c1c3be04922", 17113),
    ("GPL-2.0-only", "44569fe7ba6e771f8c140b0429cf1a17", 14480),
    ("GPL-2.0-only", "4e2a030204189bb22b07129b0bfa63db", 17007),
    ("GPL-2.0-only", "5b423ea10083ebf33006c3e7f7aacbcf", 14382),
    ("GPL-2.0-only", "6f7ccd80f4a1dd38987aa1e140fb2861", 17054),
    ("GPL-2.0-only", "70977ed1bb16e892f764d2698665cd9d", 14437),
    ("GPL-2.0-only", "7f0485f7a3fdff3feffb265391c52fb0", 17081),
    ("GPL-2.0-only", "84a1128f58935487b729a6523fc2f8c6", 14452),
    ("GPL-2.0-only", "8c4dd75a818cd9d3ed81b0cddf864600", 17086),
    ("GPL-2.0-only", "955e1d1ea98abc4e1f72a0bf6055582b", 14451),
    ("GPL-2.0-only", "9840fd8fa6c72a0398083b2cd228c1df", 14424),
    ("GPL-2.0-only", "9c4e9085f4afc39c571358027504987d", 17115),
    ("GPL-2.0-only", "a4a7c1daca89861ba6cfcd33e56440f2", 14452),
    ("GPL-2.0-only", "b0df097390663ca494081aad7f88ff72", 14424),
    ("GPL-2.0-only", "ba8708f29f8930098bf82531386e8977", 14409),
    ("GPL-2.0-only", "e0c304e1b917d4d1536d96cd5dae6d62", 14425),
    ("GPL-2.0-only", "e3018ee750f3c83a53e0a4b54732cff8", 16980),
    ("GPL-2.0-only", "e43115d847a52101aa042af49af2e9cf", 14410),
    ("GPL-2.0-only", "efdec2dc7faadbc16e9a815d5511b6f5", 14397),
    ("GPL-3.0-only", "0b26c24d572b8f48166bbbfc0c3f3bdc", 33367),
    ("GPL-3.0-only", "1342add331055277fdf611d11dca64b8", 33394),
    ("GPL-3.0-only", "4e851631a70e48876a164ce9af71baca", 33369),
    ("GPL-3.0-only", "799fe44864f0a9d2c036e97e4a434d11", 30956),
    ("GPL-3.0-only", "aaf1133d93dbb80e240ffabbc736b8b0", 30929),
    ("GPL-3.0-only", "b24eac76f647509d21a6927a5a54b769", 33396),
    ("GPL-3.0-only", "c42bbbbf70129dab0f91b3dc386b885a", 30928),
    ("GPL-3.0-only", "cdd876b4cc3527155c966698c1a93c06", 30901),
    ("LGPL-2.0-only", "31cdd18a73ea38d4ddf246a095937b20", 22245),
    ("LGPL-2.0-only", "43aed34171accf5af957a6f4e3558194", 22238),
    ("LGPL-2.0-only", "79cc1f9b4e29febb15d5a5dccc7382f3", 24135),
    ("LGPL-2.0-only", "9f7c0b91497110e703716bb0854250a6", 24091),
    ("LGPL-2.0-only", "ca1c6e193db1a4bac45393f980357c55", 22273),
    ("LGPL-2.0-only", "d153b90be8723d8d98f8b7f22d93f169", 24100),
    ("LGPL-2.0-only", "e314826a21ed851d8e021d03314b8ccf", 22210),
    ("LGPL-2.0-only", "ebf358251bfe9161668a8c8251261977", 24126),
    ("LGPL-2.1-only", "03233f139ec9adf3f072b018d2fa0cae", 23319),
    ("LGPL-2.1-only", "090c894989259d7ef5c305456106f8e7", 23291),
    ("LGPL-2.1-only", "1ff066c677365f47fea81c911a7c822e", 25213),
    ("LGPL-2.1-only", "3711b3cc30947455e35710cf26cae8c0", 25107),
    ("LGPL-2.1-only", "4c50dcd1652110666a1da6334bb69e96", 25073),
    ("LGPL-2.1-only", "5510b1a34afecb1c98ea298fa37ca7ec", 23333),
    ("LGPL-2.1-only", "678176bc76eced93c061414ea9afa263", 23361),
    ("LGPL-2.1-only", "8f0d0f261a3731933dd9032b8f6406f9", 23257),
    ("LGPL-2.1-only", "b9f7da0cf1765d5bdbd7c22dfccf1a11", 23285),
    ("LGPL-2.1-only", "c11c62d08120ca514626036822df17ec", 23299),
    ("LGPL-2.1-only", "c37131ccb120e364f7c28843ac4972ed", 25179),
    ("LGPL-2.1-only", "e4a5976403d895e4748cfe0c30a02b22", 23327),
    ("LGPL-3.0-only", "33fad1678ccee0a0d16f8788ad08749e", 7070),
    ("LGPL-3.0-only", "b31b7335bc37919e8cdd79154e04d88d", 7104),
    ("MPL-1.1", "27cc90db81a98e297f1e02c9acb7681d", 22430),
    ("MPL-1.1", "28028c908ed04455e0b3ce6aaef44a30", 22465),
    ("MPL-2.0", "1ca3284d047bb28a3ef7c11ffd19f037", 14307),
    ("MPL-2.0", "9da8a003e38a2f53dddc9e31a2b47066", 14306),
    ("MPL-2.0", "b5b7a0cf4994910cd0204fba4637d6ec", 14341),
    ("MPL-2.0", "db12a21e89062c14ac06f7d6aa8123d5", 14342),
    ("OFL-1.1", "094812ebc7f78c33cd66fea1a6c58562", 3846),
    ("OFL-1.1", "aadee3b36bd281cdd024c6e49e536ff4", 3868),
    ("Unicode-3.0", "2f99603b8ce437606595b6526ad2cc3c", 1891),
    ("Zlib", "2d68b17310a32a5ee86b5adbf052f7de", 791),
    ("Zlib", "ebae4500615bebe49184440eea790b79", 778),
]
