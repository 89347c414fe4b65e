"""Record schemas of machine inventories and hardware catalogs."""

VM = "provider string, id string, name string, type_id string, region string, status string, raw_status string, memory_gb double, disk_gb double, ipv4 string, ipv6 string, image string, created_at timestamp, labels map<string,string>, tags array<string>, attached array<struct<kind:string,id:string,name:string>>"
VM_TYPE = "id string, name string, vcpu int, memory_gb double, disk_gb double, arch string, available_regions array<string>"
REGION = "id string, name string"
IMAGE = "id string, name string, arch string, available_regions array<string>"
INCOMPLETE_READ = "provider string, reason string, pages_read int"
RECEIPT = "provider string, vm_id string, action_id string, status string"
ACTION_STATUS = "id string, state string, message string"
LIMITS = "max_vcpu double, max_memory_gb double, max_disk_gb double"
#: Default creation ceilings.
DEFAULT_LIMITS = (8.0, 8.0, 128.0)

#: Raw pages of the two providers, only the fields that are used.
HETZNER_SERVER = "id bigint, name string, status string, server_type struct<id:bigint,name:string,memory:double,disk:double>, datacenter struct<location:struct<name:string>>, public_net struct<ipv4:struct<ip:string>,ipv6:struct<ip:string>>, image struct<id:bigint,name:string>, created timestamp, labels map<string,string>, volumes array<bigint>"
HETZNER_TYPE = "id bigint, name string, cores int, memory double, disk double, architecture string, deprecation struct<unavailable_after:timestamp>, prices array<struct<location:string>>"
HETZNER_LOCATION = "id bigint, name string, description string"
HETZNER_IMAGE = "id bigint, name string, architecture string, type string, status string"
HETZNER_ACTION = "id bigint, status string, error struct<code:string,message:string>"
DO_DROPLET = "id bigint, name string, status string, size_slug string, region struct<slug:string>, networks struct<v4:array<struct<ip_address:string,type:string>>,v6:array<struct<ip_address:string,type:string>>>, image struct<id:bigint,slug:string>, created_at timestamp, tags array<string>, volume_ids array<string>, memory double, disk double, vcpus int"
DO_SIZE = "slug string, vcpus int, memory double, disk double, regions array<string>, available boolean"
DO_REGION = "slug string, name string, available boolean"
DO_IMAGE = "id bigint, slug string, name string, distribution string, regions array<string>"
DO_ACTION = "id bigint, status string, type string"
